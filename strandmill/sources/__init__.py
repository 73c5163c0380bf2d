"""Readers and writers of sequence, alignment and report files."""
