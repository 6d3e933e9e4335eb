"""Operators of a training-data pipeline; nothing outside this folder imports it.

`queries` registers one query per operator. Text work runs in Arrow batches, one task's batch at a time;
everything that must meet across documents (groups, links, counts) is left to Spark's shuffles.
"""
