"""Operators for preparing text corpora on Spark, one module per operator.

decontaminate  - benchmark passages in documents (prefix-filtered set join)
mixing         - source mixing by systematic sampling
sharding       - shards cut from a Hilbert-curve order
neardup        - near-duplicate groups by an LSH forest
chat           - conversations rebuilt from event logs and rendered
substrings     - long repeated spans by compacted k-mer paths
warc           - WARC records in ZIP packages, written and range-read
pii            - personal data by boosted trees over candidate spans
linededup      - lines repeated across documents
quality        - distribution divergence from language references
langid         - language by unigram pieces, summed over all segmentations
merkle         - Merkle manifest of a dataset by lag/lead windows, with proofs
hardneg        - hard negatives over Hilbert-ordered blocks with zone maps
queries        - the registered queries and their SQL
"""
