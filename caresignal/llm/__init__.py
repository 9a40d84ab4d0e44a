"""Corpus operators for training data. Nothing outside this subpackage imports it;
`queries` holds the registered queries and their DuckDB SQL."""
