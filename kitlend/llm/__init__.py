"""Operators for preparing training data: chat formatting, token counts, BPE
coding, source mixing, near-duplicate removal, toxicity, HTML extraction, exact
top-k search, quality rules and WARC archives. Each operator has a module of
its own; ``queries`` registers one query for each."""
