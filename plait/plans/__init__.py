"""Planning helpers: staged tables, connected components, the chain from reads to a report."""
