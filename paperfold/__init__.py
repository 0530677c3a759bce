"""paperfold: document records as Spark tables.

Extracted document content becomes typed, queryable tables: versioned field
schemas, value coercion, header/row flattening, deduplication, review,
rename-aware typed views, scoped questions, passage retrieval and job/chat
reports, all as DataFrame jobs over whole tables.
"""
