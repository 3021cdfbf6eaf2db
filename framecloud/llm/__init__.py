"""Operators of a training-data pipeline over text, pages, vectors and chats.

Nothing outside this folder imports it. ``queries`` names one query per operator.
"""
