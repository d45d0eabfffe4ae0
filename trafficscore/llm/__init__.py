"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this package; it may import the library's
general helpers.  One module per operator:

``bpe`` ``simhash`` ``syncmers`` ``secrets`` ``pii`` ``sharding`` ``suffixes``
``quality`` ``pages`` ``decontam`` ``licenses`` (its texts in ``license_texts``)
``variants`` ``lexical``; shared helpers in ``common``; the registered
queries in ``queries``.
"""
