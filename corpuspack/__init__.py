"""Spark-native packing of repetitive text into token budgets, with operators for training data."""

from importlib import import_module

__version__ = "0.3.0"

#: What the package offers at its top, by module; imported when first asked for.
_OFFERED = {
    "functions.text": ("token_estimate", "template_id", "page_fingerprint", "register"),
    "operators.packing": ("FlatOptions", "HierarchicalOptions", "encode_pages", "flat_pack", "hierarchical_pack", "hierarchical_unpack"),
    "operators.codebook": ("decode", "encode"),
    "operators.paging": ("line_pages", "paginate"),
    "operators.budget": ("BudgetOptions", "budget_pack", "cold_rows", "decoded_page", "decoded_pages", "decoded_texts"),
    "operators.directory": ("directory_tree", "sheets_of_page", "shown_sheets"),
    "operators.scope": ("ScopeOptions", "decode_scopes", "encode_scopes", "scope_dictionary"),
    "operators.compaction": ("CompactOptions", "compact_messages", "expand_messages", "expand_recursive"),
    "operators.recall": ("fragment", "keyword_scores", "keyword_search", "recall", "recall_by_ids"),
    "operators.gram_index": ("keyword_scores_many", "keyword_search_many", "read_gram_index", "recall_by_table", "write_gram_index"),
    "operators.evaluate": ("label_matches", "micro_precision_recall", "phrase_coverage", "run_conditions", "score_conditions", "summarise"),
    "sources.tables": ("read_cold_store", "read_messages", "read_packed", "read_texts", "write_cold_store", "write_packed", "write_prompts"),
    "sources.pages": ("register_pages",),
    "streaming.ingest": ("finalise", "ingest_pages", "template_stream"),
    "streaming.state": ("ranked_templates", "template_state"),
    "plans.facade": ("PromptMemory",),
}
_WHERE = {name: module for module, names in _OFFERED.items() for name in names}
__all__ = ["__version__", *sorted(_WHERE)]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return __all__
