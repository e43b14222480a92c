"""Operators of a training-data pipeline; nothing else in the library imports this package.

``sharding`` ``decontaminate`` ``ngram_join`` ``line_dedup`` ``language`` ``quality`` ``topk``
``mixing`` ``suffix_dedup`` ``licenses`` are the operators, ``queries`` registers one query for
each, ``flow`` ``tokens`` ``components`` are what they share.
"""
