"""Operators and a pipeline for preparing training data: quality, mixing, decontamination, near-duplicates, chat, language, toxicity."""
