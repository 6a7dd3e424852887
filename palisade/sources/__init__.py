"""Readers of corpora, rules, feeds, reports and logs; writers of tables and documents."""
