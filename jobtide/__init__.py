"""Skill and labour-market analytics as PySpark jobs."""
