"""Conversation-interval analytics on Spark DataFrames."""
