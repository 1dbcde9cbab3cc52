"""Training-data preparation operators (deduplication, language, search, mixing, archives).

Nothing outside this subpackage imports it.  ``lectern.llm.queries`` lists the
driver-facing queries; every operator also has its own general interface.
"""
