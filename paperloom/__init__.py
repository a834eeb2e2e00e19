"""paperloom: build and curate a corpus of scientific papers with Spark.

Layers, from the inside out:

* ``functions``  - ``Column -> Column`` rules (versions, replies, JSON checks, chunking)
* ``operators``  - ``DataFrame(s) -> DataFrame`` relational steps, no side effects
* ``sources``    - readers and writers (JSON Lines, binary artifacts, change logs)
* ``plans``      - jobs that chain operators over stored tables, and the query registry
* ``streaming``  - the Structured Streaming form of the labeling job
"""
