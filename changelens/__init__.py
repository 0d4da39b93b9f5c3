"""changelens: code-review analytics as Spark DataFrame operators.

Entry points (all ``DataFrame -> DataFrame``, lazy unless noted):

* ``operators.scans``: the composed jobs - ``duplicate_scan``,
  ``architecture_facts``, ``review_requests``.
* ``operators.dedup``: ``shingle_similar_pairs`` (scale path, checkpoints
  its shingle sets), ``similar_pairs_exact`` (difflib ratio, checkpoints its
  scores), ``copy_groups``, ``size_histogram``, ``candidate_pairs``.
* ``operators.units`` / ``structure`` / ``graph``: segmentation, imports and
  symbols, import graph, degrees, top modules, diagram and structure text.
* ``operators.diffs`` / ``languages`` / ``targets`` / ``outcomes`` / ``caps``.
* ``operators.inference`` / ``render``: requests, model call, answer checks,
  findings, comments, tests report.
* ``sources``: file listing, payload decoding, diffs, idempotent sinks.
* ``streaming.webhooks``: signed deliveries, relevant events, review stream.
"""

__version__ = "0.1.0"
