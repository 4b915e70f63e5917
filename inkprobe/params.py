"""Constants shared by the Spark plans and their SQL twins."""

from __future__ import annotations

SEED = 42
N_CHUNKS = 5
MIN_TOKENS = 100
VOCAB_SIZE = 32_000  # of the capped vocabulary, where one is asked for
LAMBDA = 0.5
HOT_SLOTS = 20_000
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
HASH_DIGITS = 4

# Reserved token ids.
UNK, BOS, EOS = 0, 1, 2
N_RESERVED = 3
UNK_TEXT = "<unk>"

# Window shape, list sizes, date bounds, guard value and
# ratios have to agree with the published method for results to agree.
CONTEXT = 128
STRIDE = 127
TOP_K = 10
N_NEIGHBOURS = 50
YEAR_LO, YEAR_HI = 1850, 1910
RELEASE_CUTOFF = "2023-02-28"
HEADER_BYTES = 1000
GUARD_VALUE = 10e-6
CERTAIN_WEIGHT = 1 - 0.9
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
MIN_K_RATIOS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
HIST_BINS = 100
GRID_BINS = 1000
TEST_SHARE = 0.2

# Report column names of the per-window scores.
REPORT_NAMES = {
    "ppl": "ppl",
    "ref_diff": "ppl/Ref_ppl (calibrate PPL to the reference model)",
    "lower_ratio": "ppl/lowercase_ppl",
    "zlib_ratio": "ppl/zlib",
    **{f"min_{int(r * 100)}": f"Min_{r * 100}% Prob" for r in MIN_K_RATIOS},
}

# The experiments, as (normalisation, norm table, features).
EXPERIMENTS = {
    "base": ("none", "token_freq", "simple_agg"),
    "base_hist": ("none", "token_freq", "hist_1000"),
    "token_freq_norm_agg": ("ratio", "token_freq", "simple_agg"),
    "token_freq_norm_hist": ("ratio", "token_freq", "hist_1000"),
    "general_proba_norm_agg": ("ratio", "general_proba", "simple_agg"),
    "general_proba_norm_hist": ("ratio", "general_proba", "hist_1000"),
    "token_freq_diff_max_agg": ("diff_max_token_proba", "token_freq", "simple_agg"),
    "token_freq_diff_max_hist": ("diff_max_token_proba", "token_freq", "hist_1000"),
    "general_proba_diff_max_agg": ("diff_max_token_proba", "general_proba", "simple_agg"),
    "general_proba_diff_max_hist": ("diff_max_token_proba", "general_proba", "hist_1000"),
}

AGG_FEATURES = ("mean", "min", "max", "std", "count") + tuple(f"perc_{p}" for p in PERCENTILES)
