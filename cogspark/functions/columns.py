"""Column expressions: knowledge updates, Bayes and exam arithmetic, and the small scalar functions."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(key: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def likelihood_ratio(p: Column, if_active: Column, if_not: Column) -> Column:
    """P(active) after evidence; unchanged if the evidence is impossible either way."""
    total = p * if_active + (1 - p) * if_not
    return F.when(total == 0, p).otherwise(p * if_active / total)


def guess_slip(kind: Column, hint: Column) -> tuple[Column, Column]:
    """Guess (higher with a hint) and slip of the kind's row."""
    rows = {k: C.GUESS_SLIP[r] for k, r in C.KIND_ROW.items()}
    g, s = (lookup(kind, {k: float(v[i]) for k, v in rows.items()}) for i in (0, 1))
    return F.when(hint, F.least(F.lit(C.HINT_CAP), g + C.HINT_BONUS)).otherwise(g), s


def item_ratios(kind: Column, correct: Column, hint: Column) -> tuple[Column, Column]:
    """(if_active, if_not) of an answer."""
    g, s = guess_slip(kind, hint)
    return F.when(correct, g).otherwise(1 - g), F.when(correct, 1 - s).otherwise(s)


def forget(p: Column, levels: Column) -> Column:
    """P(active) after so many levels of forgetting."""
    return 1 - (1 - p) * F.pow(F.lit(1 - C.FORGET_RATE), F.greatest(levels, F.lit(0)))


#: The least number that has k + 1 hundredths when written with two digits, for k from 0 to 99.
_HUNDREDTHS = [m if float(f"{m:.2f}") > k / 100 else math.nextafter(m, 1) for k in range(100) for m in [(2 * k + 1) / 200]]


def two_digits(p: Column) -> Column:
    """A probability as text with two digits, by its exact binary value as in C; Spark's own format rounds its shortest decimal half up."""
    at = F.floor(p * 100).cast("int")
    n = at + F.when(p >= F.get(F.lit(_HUNDREDTHS), at), 1).otherwise(0)
    text = F.concat((n / 100).cast("int").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(p.between(0, 1), text).otherwise(F.format_string("%.2f", p))


def band(p: Column) -> Column:
    return F.when(p >= C.LIKELY, "Likely").when(p >= C.POSSIBLE, "Possible").otherwise("Unsure")


def domain_of(problem_id: Column) -> Column:
    return F.when(problem_id.startswith("P"), "main").when(problem_id.startswith("Q"), "dsa").otherwise("other")


def components_of(op_id: Column) -> Column:
    """The parts of an operator id."""
    return F.filter(F.split(op_id, r"\+"), lambda x: F.trim(x) != "")


def base_voice(voice: Column) -> Column:
    """The voice without the mark of those that were told the answer."""
    return F.regexp_replace(voice, r"_told$", "")


def language_of(voice: Column) -> Column:
    """Hinglish for the voices written in it, English for all others."""
    return F.when((voice == "hinglish") | voice.startswith("persona_friend"), "Hinglish").otherwise("English")


def clean(text: Column, most: int = C.MAX_CHARS) -> Column:
    """What a reader is given: cut to its length, outer blanks removed; null is empty."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, most), r"^\s+|\s+$", "")


def aug_limit(op_id: Column, n_sites: Column, listed=()) -> Column:
    """How often an operator with so many sites may be augmented."""
    often = (n_sites < 24) | op_id.startswith("d0") | op_id.isin(list(listed))
    return F.when(often, 16).when(op_id.startswith("oth_") | (n_sites < 40), 6).otherwise(4)


def is_transfer_family(class_: Column, found: Column, family: Column) -> Column:
    """A listed family of the class, other than where the misconception was found."""
    listed = F.lit(False)
    for k, families in C.TRANSFER_FAMILIES.items():
        listed = listed | ((class_ == k) & family.isin(families))
    return F.coalesce(listed & ~family.eqNullSafe(found), F.lit(False))


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def class_eig(p: Column, exposure: Column, if_not: float = C.FAIL_IF_NOT, inside: bool = False) -> Column:
    """Bits that one pass-or-fail test of a class is expected to give. inside: within a lambda, where Spark does not share what occurs twice."""
    keep = let if inside else (lambda value, body: body(value))
    fail = p * exposure + (1 - p) * if_not
    after_fail = likelihood_ratio(p, exposure, F.lit(if_not))
    after_pass = likelihood_ratio(p, 1 - exposure, F.lit(1 - if_not))
    gain = binary_entropy(p) - (fail * keep(after_fail, binary_entropy) + (1 - fail) * keep(after_pass, binary_entropy))
    return keep(gain, lambda g: F.when((g < 0) & (g > -1e-12), 0.0).otherwise(g))


def pass_probability(difficulty: Column, theta: Column) -> Column:
    rating = lookup(difficulty, {k: float(v) for k, v in C.ELO_ITEM.items()})
    return 1 / (1 + F.pow(F.lit(10.0), (rating - theta) / 400))


def tie_key(*parts: Column) -> Column:
    """16 hex digits that split ties the same way each time."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def twin_of(a: Column, b: Column) -> Column:
    """The set of look-alikes that has both, or null."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return lookup(pair, {"|".join(sorted(v)): k for k, v in C.TWIN_SETS.items()})


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """An array's softmax."""
    top = F.array_max(logits)
    return let(F.transform(logits, lambda x: F.exp((x - top) / temperature)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def flat(text: Column) -> Column:
    """Text with its white space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("h_"), F.substring(F.sha2(flat(F.lower(text)), 256), 1, 16))


def same_answer(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal as numbers within the tolerance, else as trimmed text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.trim(a) == F.trim(b))


def bucket(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys, F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in the longest matching blocks, found recursively left and right of the longest, by the length of both texts."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio(a, b)


def is_close(a: Column, b: Column, limit: float = C.TOO_CLOSE) -> Column:
    """Whether matching_ratio is above the limit; bounds by length and by letters are tried first."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            m = SequenceMatcher(None, x, y)
            return m.real_quick_ratio() > limit and m.quick_ratio() > limit and m.ratio() > limit

        return pd.Series([x is not None and y is not None and one(x, y) for x, y in zip(a, b)], dtype="bool")

    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    near = 2 * shorter > limit * (shorter + longer)
    return F.when((longer == 0) | near, close(a, b)).otherwise(False)


def flat(code: Column) -> Column:
    """A program with each run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(code, r"\s+", " "))
