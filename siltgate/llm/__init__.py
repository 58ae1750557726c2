"""Training-data operators: quality, mixing, toxicity, chat, tokens, dedup, licences, decontamination.

Nothing outside this subpackage imports it.
"""
