"""All core queries by name, each with its SQL where SQL can express it."""

from phylospark.plans import evolution_queries, file_queries, locus_queries, reconstruction_queries, summary_queries, tree_queries

FLAGSHIP = "grf_region_tree"
_ALL = {name: pair for module in (tree_queries, locus_queries, evolution_queries, reconstruction_queries, summary_queries, file_queries) for name, pair in module.QUERIES.items()}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
