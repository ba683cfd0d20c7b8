"""Operators over boards, answers, questions and entity names. All lazy."""
