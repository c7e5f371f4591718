"""Operators from DataFrame to DataFrame: backends, hints, voting, fusion, context, confusion, code switching, evaluation."""
