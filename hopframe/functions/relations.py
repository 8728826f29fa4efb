"""Relation names resolved to node types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The node types that a well-known relation leads to.
ALIASES = {
    "reference": ["paper_nodes", "paper"], "cited_by": ["paper_nodes", "paper"], "paper": ["paper_nodes", "paper"], "papers": ["paper_nodes", "paper"],
    "author": ["author_nodes"], "authors": ["author_nodes"], "venue": ["venue_nodes"], "venues": ["venue_nodes"], "field": ["field_nodes"], "fields": ["field_nodes"],
}


def named_type(name: Column, types: Column) -> Column:
    """The first that the graph has of: the name, with _nodes, its plural, that with _nodes, its aliases. Case counts."""
    aliases = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    candidates = F.concat(F.array(name, F.concat(name, F.lit("_nodes")), F.concat(name, F.lit("s")), F.concat(name, F.lit("s_nodes"))), F.coalesce(F.try_element_at(aliases, name), F.array().cast("array<string>")))
    return F.get(F.filter(candidates, lambda x: F.array_contains(types, x)), F.lit(0))


def resolve_relation(rel: Column, source_type: Column, types: Column) -> Column:
    """The node type a relation leads to: by its name; in a graph of one type, that; else by the far end of a name of
    three parts or more with hyphens, the end that isn't the source's. Null if none."""
    parts = F.filter(F.transform(F.split(rel, "-"), lambda x: F.trim(x)), lambda x: x != "")
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    far = F.when(F.size(parts) >= 3, F.when(head == F.regexp_replace(source_type, "_nodes$", ""), tail).otherwise(head))
    single = F.when(F.size(types) == 1, F.get(types, F.lit(0)))
    return F.coalesce(named_type(rel, types), single, F.when(far.isNotNull(), named_type(far, types)))
