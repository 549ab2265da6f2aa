"""Operators for training data: line repetition, splitting, masking, pair checks,
main body, packing, leakage and keyword spam. Nothing outside imports this subpackage."""
