"""Vocabularies and numbers set by hand that results depend on."""

MAIN_CLASSES = ["M01", "M02", "M03", "M04", "M05", "M06", "M07", "M08", "M10"]
DSA_CLASSES = ["D01", "D02", "D03", "D04", "D05", "D06", "D07", "D08"]
MISCONCEPTIONS = MAIN_CLASSES + DSA_CLASSES
LABELS = MISCONCEPTIONS + ["CORRECT", "OTHER"]
STATES = ["UNSEEN", "ACTIVE", "TREATING", "PROBATION", "STABLE", "MASTERED", "RELAPSED"]
TWIN_SETS = {"T1": ("M01", "M08"), "T2": ("M02", "M07"), "T3": ("M06", "M07"), "T4": ("M03", "M05"), "T5": ("M09", "M10"), "T6": ("D02", "M02"), "T7": ("D05", "D06"), "T8": ("D07", "M10"), "T9": ("D01", "M03")}
# fixed values: the features of which one has to be present for a class to be possible
MASK_PRECONDITIONS = {
    "D02": ["a_mid_like_var"],
    "D03": ["a_has_array_write"],
    "D04": ["a_has_array_write"],
    "D05": ["a_has_recursion"],
    "D06": ["a_has_recursion"],
    "D07": ["a_has_recursion"],
    "D08": ["a_str_literal_compare", "a_array_name_compare", "a_char_array_param"],
}

# answers and priors
P_BELIEF, Q_CORRECT, SLIP, P_OTHER_CORRECT, PROB_FLOOR = 0.6, 0.5, 0.1, 0.4, 0.02
PRIOR_GAMMA, PRIOR_FLOOR, POPULATION_PRIOR = 0.3, 0.02, 0.10
TEXT_EPSILON, TEXT_BETA, TEXT_MATCH_P, TEXT_IF_ACTIVE, TEXT_IF_NOT = 0.02, 0.5, 0.6, 0.5, 0.05

# decisions
CONFIDENT_P, CONFIDENT_MARGIN, POSTERIOR_STOP, EIG_MIN_BITS, MAX_PROBES, TWO_BUG_P2 = 0.75, 0.25, 0.85, 0.10, 2, 0.25
LIKELY, POSSIBLE = 0.75, 0.45
LATENT_MIN_P, TOP_MIN_P = 0.5, 0.02

# knowledge
ACTIVE_P, LEARN_RATE, FORGET_RATE = 0.5, 0.35, 0.05
HINT_BONUS, HINT_CAP = 0.2, 0.9
FAIL_IF_ACTIVE, FAIL_IF_NOT, LATENT_FACTOR = 0.5, 0.03, 0.5
STABLE_P, MASTERED_P, EXAM_MASTERY_EXPOSURE = 0.15, 0.10, 0.4
#: guess and slip of each kind of item
GUESS_SLIP = {
    "same_family_code": (0.45, 0.10),
    "transfer_code": (0.30, 0.15),
    "trap": (0.15, 0.10),
    "belief_mcq": (0.2, 0.10),
    "ghost": (0.25, 0.15),
    "exam_code": (0.30, 0.15),
    "debug_line": (0.30, 0.20),
    "fix_bug": (0.35, 0.15),
}
#: kinds of answers and the row of GUESS_SLIP that each reads
KIND_ROW = {
    "same_family_code": "same_family_code",
    "transfer_code": "transfer_code",
    "trap": "trap",
    "belief_mcq": "belief_mcq",
    "ghost": "ghost",
    "exam_code": "exam_code",
    "exam_trace": "belief_mcq",
    "mcq": "belief_mcq",
    "predict_output": "belief_mcq",
    "predict_output_trap": "trap",
    "next_state": "belief_mcq",
    "complete_snippet": "same_family_code",
    "debug_line": "debug_line",
    "fix_bug": "fix_bug",
}
#: families of problems that count as transfer for a class
TRANSFER_FAMILIES = {
    "M01": ["count_loop", "countdown_loop", "prefix_loop"],
    "M02": ["while_progress", "count_loop"],
    "M03": ["array_accumulate", "accumulate_product", "array_count_if"],
    "M04": ["average", "ratio"],
    "M05": ["array_accumulate", "accumulate_product", "array_count_if"],
    "M06": ["equality_check", "branch_bands", "while_progress"],
    "M07": ["equality_check", "branch_bands", "while_progress"],
    "M08": ["index_access", "array_accumulate", "array_max"],
    "M10": ["return_value", "index_access", "equality_check", "pairwise_check"],
    "D01": ["linear_search", "pairwise_check", "string_two_pointer", "flag_search"],
    "D02": ["binary_search", "guess_halving"],
    "D03": ["bubble_sort", "selection_sort", "two_pointer_swap", "shift"],
    "D04": ["bubble_sort", "selection_sort"],
    "D05": ["rec_product", "rec_digits", "rec_array"],
    "D06": ["rec_product", "rec_digits", "rec_array"],
    "D07": ["rec_product", "rec_digits", "rec_array"],
    "D08": ["string_count", "string_two_pointer"],
}

# exams
ELO_START, ELO_BONUS, ELO_K = 1300, 100, 40
ELO_ITEM = {1: 1200, 2: 1400, 3: 1600}
EXAM_COST = {"coding": 1.0, "trace": 0.3}
EXAM_MIN_EXPOSURE, EXAM_W_COVERAGE, EXAM_W_DIFFICULTY, EXAM_TARGET_PASS, EXAM_W_GHOST = 0.2, 0.5, 0.4, 0.6, 0.3
BAND_LOW, BAND_HIGH, DEFERRED_PROBES, RECOMMENDATIONS = 0.3, 0.7, 3, 2
LIVE_STATES = ["ACTIVE", "TREATING", "PROBATION", "RELAPSED"]
AT_RISK_MIN = 0.35

# quality rules and evaluation
LABEL_FLOOR, DROP_LIMIT, STUMP_LIMIT, BLEED_LIMIT, CORRELATION_LIMIT, EXPOSURE_GAP = 80, 0.40, 0.60, 0.30, 0.95, 0.30
CONSTANT_SHARE, KS_D, KS_P, KS_N, EVENT_SHARE, SHIFT_AUC = 0.99, 0.25, 0.01, 20, 0.50, 0.85
SILHOUETTE_LIMIT = 0.20
BINS, T_LOW, T_HIGH = 10, 0.5, 5.0
READER_PRECISION, READER_ACCEPTED, READER_NEVER = 0.90, 10, 1.01
MAX_CHARS, MAX_WRITES, MAX_READS = 2000, 24, 30
LABEL_TOTAL = 4000
AUDIT_CONFIDENCE = 0.6
#: draws with a defined statistic below which there is no interval
MIN_DRAWS = 100
EXAM_TIME_LIMIT_S = 1500
EXAM_DSA_PRIOR = 0.15
TRIAL_START, TRIAL_PASS, TRIAL_FAIL, TRIAL_SKIP, TRIAL_FLOOR, UNRESOLVED_P = 1400, 40, 30, 20, 1100, 0.70
NOVEL_P_OTHER = 0.5
#: what the interpreter reads from memory that was never written, and how far arithmetic takes it
GARBAGE, GARBAGE_BAND = -858993460, 1_000_000
#: weights of several kinds of evidence for one answer
FOUND_FACTOR, NOT_FOUND_FACTOR, FOUND_OUTSIDE, CUE_FACTOR, CUE_STRENGTH = 3.0, 0.20, 2.0, 0.5, 0.7
HEDGE_PENALTY, HEDGE_MOST, HEDGE_FLOOR, FUSE_MARGIN, AMBIGUOUS_P, CORRECT_P = 0.08, 0.15, 0.40, 0.15, 0.48, 0.95

#: what a learner's client may see of each kind of entity: no answers, beliefs or exposures
PUBLIC_FIELDS = {
    "exam_coding": ["item_id", "kind", "sector", "difficulty", "markers", "sample_tests", "options", "prompt", "signature", "starter"],
    "exam_trace": ["item_id", "kind", "sector", "difficulty", "markers", "sample_tests", "options", "code", "question"],
    "quiz": ["item_id", "type", "concept", "code", "question", "options", "difficulty"],
    "code": ["item_id", "type", "problem_id", "starter", "holes", "code", "allow_no_bug"],
    "probe": ["probe_id", "prompt", "code", "options"],
}

# What tells each class by features alone, tried in this order. A bare name means that the feature is not 0.
RULES = {
    "D08": "a_str_literal_compare or a_array_name_compare or b_str_literal_compare or b_array_compare",
    "D05": "a_has_recursion and (not a_base_case_present or (not a_base_case_static_reachable and not a_rec_arg_form_same and not a_rec_arg_form_plus1))",
    "D06": "a_has_recursion and (a_rec_arg_form_same or a_rec_arg_form_plus1 or b_rec_arg_constant or b_rec_arg_growing)",
    "D07": "a_rec_call_discarded or b_discarded_call_value",
    "D03": "a_swap_no_temp or b_multiset_changed or r_eq_shift_without_wrap > 0",
    "D02": "a_mid_assign_no_offset",
    "D04": "a_outer_bound_const1 or r_eq_one_pass > 0 or (a_single_loop_with_swap and a_index_pair_plus1)",
    "D01": "a_return_in_loop_else or a_assign_in_loop_else",
    "M07": "a_empty_body_if or a_empty_body_for or a_empty_body_while or b_empty_body_exec",
    "M06": "a_assign_in_cond or b_assign_in_cond_rt",
    "M05": "a_decl_noinit_read_first or b_uninit_read",
    "M02": "b_step_cap or (a_n_loops and (not a_update_present or not a_update_var_is_cond_var or a_update_in_branch))",
    "M10": "a_printf_in_nonvoid and (a_nonvoid_missing_return or a_return_const_only or b_printed_eq_ref_return > 0)",
    "M04": "a_int_div_into_float or a_cast_wraps_division or r_eq_floor_ref > 0",
    "M03": "a_init_inside_loop or r_eq_ref_last_only >= 0.5",
    "M08": "b_oob_read_idx_eq_n or a_index_n or a_index_const1 or a_array_loop_le_n or a_index_mirror_n_minus_i or (a_index_i_plus_1 and not a_index_pair_plus1) or (a_array_loop_start1 and not a_index_const0)",
    "M01": "b_iter_delta_const_pm1 or a_bound_form_n_plus_1 or (a_main_cond_op_le and a_bound_form_n and a_init_form_0 and a_update_dir > 0)",
}

# fixed values: kinds of effects in the order in which they tell most, rows of a timeline up to which missing passes follow
EFFECT_ORDER = ["read_void", "write_cell", "compare", "read_cell", "call", "ret"]
TIMELINE_MOST = 60
#: Items of each kind that a bank has for each class, and how alike two programs of a class may be.
WANTED = {"predict_output": 2, "mcq": 2, "next_state": 1, "reasoning": 1}
TOO_CLOSE = 0.8
