"""DataFrame operators."""

from textloom.operators.batching import assign_batches, collate, map_batches, plan_steps, seeded_order, with_labels
from textloom.operators.candidates import nucleus_filter
from textloom.operators.classification import (
    class_counts,
    class_report,
    classification_summary,
    confusion_matrix,
    evaluate_classification,
)
from textloom.operators.generation import (
    collect_sequences,
    expand_sequences,
    generate,
    padding_report,
    parse_requests,
    predict,
    to_response,
    with_defaults,
    without_prompt,
)
from textloom.operators.language_model import BigramModel, batch_losses, fit_bigrams, perplexities, perplexity, score_texts
from textloom.operators.monitoring import (
    rank_error,
    roll_up,
    sketched_window_metrics,
    window_metrics,
    window_sketches,
)
from textloom.operators.overlap import (
    align_pairs,
    align_positions,
    bleu,
    bleu_counts,
    bootstrap_mean,
    bootstrap_means,
    evaluate_generated_text,
    rouge,
    rouge_scores,
)
from textloom.operators.prepare import (
    count_rows,
    drop_empty,
    length_report,
    pad_and_mask,
    pad_token,
    prepare_text,
    row_report,
)
from textloom.operators.quantiles import exact_quantiles
from textloom.operators.ranking import add_position
from textloom.operators.runs import best_step, compare_runs, early_stop, every_nth_step
from textloom.operators.tokenisers import tokenise_with_file
from textloom.operators.versions import (
    diff_summary,
    differing_buckets,
    fingerprint,
    store_version,
    stored_changes,
    version_diff,
)
from textloom.operators.vocabulary import decode, encode, fit_vocabulary

__all__ = [
    "BigramModel",
    "add_position",
    "align_pairs",
    "align_positions",
    "assign_batches",
    "batch_losses",
    "best_step",
    "bleu",
    "bleu_counts",
    "bootstrap_mean",
    "bootstrap_means",
    "class_counts",
    "class_report",
    "classification_summary",
    "collate",
    "collect_sequences",
    "compare_runs",
    "confusion_matrix",
    "count_rows",
    "decode",
    "diff_summary",
    "differing_buckets",
    "drop_empty",
    "early_stop",
    "encode",
    "evaluate_classification",
    "evaluate_generated_text",
    "every_nth_step",
    "exact_quantiles",
    "expand_sequences",
    "fingerprint",
    "fit_bigrams",
    "fit_vocabulary",
    "generate",
    "length_report",
    "map_batches",
    "nucleus_filter",
    "pad_and_mask",
    "pad_token",
    "padding_report",
    "parse_requests",
    "perplexities",
    "perplexity",
    "plan_steps",
    "predict",
    "prepare_text",
    "rank_error",
    "roll_up",
    "rouge",
    "rouge_scores",
    "row_report",
    "score_texts",
    "seeded_order",
    "sketched_window_metrics",
    "store_version",
    "stored_changes",
    "to_response",
    "tokenise_with_file",
    "version_diff",
    "window_metrics",
    "window_sketches",
    "with_defaults",
    "with_labels",
    "without_prompt",
]
