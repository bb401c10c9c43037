"""No streaming operators.

The workload has no unbounded input, watermark or state: every source is a
complete table. The column expressions in ``tallyforge.functions`` are stateless,
so they also run on a ``readStream`` DataFrame unchanged (see
``tests/test_text.py``); nothing stream-specific is needed here.
"""
