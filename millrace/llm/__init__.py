"""Operators of a training-data pipeline: chat formatting, de-duplication, decontamination, filtering and token output."""
