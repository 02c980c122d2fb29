"""Documents with the awkward cases: nulls, empty and long texts, copies, near copies, ties, repeated rows, clashing columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, set string, block long, id long, tie long, __id long, __letters string, __size int, toxic double, row string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 160))]
        if i % 7 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words)))
    base = [word() for _ in range(120)]
    for k in range(6):  # near copies
        w = list(base)
        w[k * 9] = word()
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1])]  # copies and a repeated row
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, "one"), (304, "one"), (None, "two three"), (305, "É" * 3 + " ünïcode 日本 text"), (306, "x" * 5000), (307, ("long " * 4000).strip()), (306, "again another text")]
    langs = ["en", "fr", None]
    return [(i, t, langs[(i or 0) % 3], None if i == 5 else f"s{(i or 0) % 4}", len(t or ""), 0.5, "x", 1, 2, 3, 4, "l", 5, 0.25, "r") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS)
