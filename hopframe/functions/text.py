"""Text functions of the question-answering side as Column builders; all run inside whole-stage code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The phrases that tell question families apart, and the words of the prompts.
WITNESS_PHRASES = ("witness node", "output yes and one witness node", "output yes plus one witness node", "or no_path", "within", "reachable from", "connect to")
TOPIC_PHRASES = ("keyword", "research interest", "area of research", "research area")
FAMILY_PHRASES = (
    ("hop", ("how many people at minimum", "least count of people", "to get introduced to", "to be familiar with")),
    ("hop", ("minimum number of graph hops", "minimum hop count", "shortest hop count", "graph hops at minimum", "hops at minimum separate")),
    ("author_lookup", ("who are the authors of", "could you tell me the authors of", "who wrote the paper")),
    ("venue_lookup", ("published", "venue", "journal", "conference")),
    ("collab_rank", ("highest number of collaborations", "closest collaborator", "closest co-author")),
    ("citation_rank", ("most frequently cited", "most cited", "highest number of citations")),
    ("counting", ("how many", "number of", "count of")),
    ("graph_lookup", ("who within", "which author", "who is", "who ")),
)
ENTITY_FAMILIES = ("author_lookup", "venue_lookup", "collab_rank", "citation_rank", "graph_lookup", "other")
OUTPUT_MODES = {"hop": "single_integer", "counting": "single_integer", "topic": "keyword_list"}
ANSWER = "Please answer the question using the graph. "
PROMPTS = {
    "single_integer": ANSWER + "Output only a single integer as the answer. Do not output JSON or extra explanation.",
    "keyword_list": ANSWER + "Output exactly 3 specific research keywords separated by commas only. Do not output JSON, sentences, author names, or broad research fields. Format: \"keyword one, keyword two, keyword three\".",
    "plain_text": ANSWER + "Output only the answer as a plain string. Do not output JSON or extra explanation.",
    "path_witness": ANSWER + "Output exactly one of the following formats only: 'yes<TAB>witness_node_id' or 'no_path'. Do not output JSON, explanations, or extra text.",
}


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def normalize(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, white space collapsed."""
    x = F.translate(F.lower(text), PUNCTUATION, "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def token_f1(pred: Column, label: Column, clipped: bool = False) -> Column:
    """Token F1; a predicted token counts as often as it is predicted (may exceed 1) unless clipped."""

    def score(both: Column) -> Column:
        p, q = both["p"], both["q"]
        common = F.size(F.array_intersect(p, q)) if clipped else F.size(F.filter(p, lambda t: F.array_contains(q, t)))
        precision, recall = common / F.greatest(F.size(p), F.lit(1)), common / F.greatest(F.size(q), F.lit(1))
        return F.when((F.size(p) > 0) & (F.size(q) > 0) & (common > 0), 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))

    # bound once: an expression that stands in the filter would split the label anew for every predicted token
    return F.transform(F.array(F.struct(tokens(pred).alias("p"), tokens(label).alias("q"))), score)[0]


def task_type(question: Column) -> Column:
    q = F.lower(question)
    witness = any_phrase(q, WITNESS_PHRASES) & any_phrase(q, ("no_path", "witness"))
    return F.when(witness, "path_witness").when(any_phrase(q, TOPIC_PHRASES), "topic").otherwise("hop")


def task_family(question: Column) -> Column:
    q, kind = F.lower(question), task_type(question)
    out = F.when(kind != "hop", kind)
    for family, phrases in FAMILY_PHRASES:
        out = out.when(any_phrase(q, phrases), family)
    return out.otherwise("other")


def output_mode(family: Column) -> Column:
    out: Column | None = None
    for k, v in OUTPUT_MODES.items():
        out = F.when(family == k, v) if out is None else out.when(family == k, v)
    return out.otherwise("plain_text")


def prompt(family: Column) -> Column:
    key = F.when(family == "path_witness", "path_witness").otherwise(output_mode(family))
    return F.element_at(F.create_map(*(F.lit(x) for kv in PROMPTS.items() for x in kv)), key)


def metric_task(question: Column, label: Column, declared: Column) -> Column:
    """The task a row is scored as: from the question, then the label, then the declared type."""
    family, text = task_family(question), F.trim(F.coalesce(label, F.lit("")))
    digits = F.regexp_replace(text, "[, ]", "").rlike("^[0-9]+$")
    return (
        F.when(family.isin("topic", "hop", "counting", "path_witness"), family)
        .when((text == "no_path") | F.lower(text).startswith("yes\t") | F.lower(text).startswith("yes "), "path_witness")
        .when(declared.isin(*ENTITY_FAMILIES), "entity")
        .when(F.contains(text, F.lit(",")) & ~digits, "topic")
        .when(text.rlike(r"^[+-]?[0-9]+$"), "counting")
        .otherwise("entity")
    )


# The phrases of the older scorer, in its order.
LEGACY_PHRASES = (
    ("path_witness", ("witness node", "output yes and one witness node", "output yes plus one witness node", "or no_path")),
    ("topic", TOPIC_PHRASES),
    ("hop", ("how many people at minimum", "least count of people", "to get introduced", "to be familiar with")),
    ("entity", ("authors of", "who wrote the paper", "who collaborate with", "who penned both", "who within")),
    ("entity", ("published", "venue did", "where did", "where has", "in which place")),
    ("entity", ("affiliation", "organization is researcher", "which organization does researcher")),
    ("entity", ("highest number of collaborations", "closest collaborator", "most frequently cited", "most cited", "collaborate most")),
    ("counting", ("how many", "number of", "count of")),
)


def legacy_metric_task(question: Column, label: Column) -> Column:
    """The task a row is scored as by the older rules: its own phrases, then the label."""
    q, text = F.lower(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    out: Column | None = None
    for task, phrases in LEGACY_PHRASES:
        hit = any_phrase(q, phrases)
        out = F.when(hit, task) if out is None else out.when(hit, task)
    digits = F.regexp_replace(text, "[, ]", "").rlike("^[0-9]+$")
    yes = (text == "no_path") | F.lower(text).startswith("yes\t") | F.lower(text).startswith("yes ")
    return out.when(yes, "path_witness").when(F.contains(text, F.lit(",")) & ~digits, "topic").when(text.rlike(r"^[+-]?[0-9]+$"), "counting").otherwise("entity")


def _payload(pred: Column) -> Column:
    """What the widest braces of a text hold, if that is one value of strict JSON, in an array; else null."""
    # a parser stops at the end of a value; within brackets what follows it is an error or a second element
    v = F.try_parse_json(F.concat(F.lit("["), F.nullif(F.regexp_extract(pred, r"(?s)\{.*\}", 0), F.lit("")), F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), v)


def parsed_answer(pred: Column) -> Column:
    """The answer field of the widest braces that are JSON, null if it is null there; without the field the text itself."""
    v = _payload(pred)
    return F.when(F.try_variant_get(v, "$[0].answer", "variant").isNotNull(), F.try_variant_get(v, "$[0].answer", "string")).otherwise(pred)


def parsed_path(pred: Column) -> Column:
    """The path field of the same, as an array; null without one."""
    return F.try_variant_get(_payload(pred), "$[0].path", "array<string>")


def first_integer(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "-?[0-9]+", 0), F.lit("")), F.trim(text))


def single_integer(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike("^-?[0-9]+$")


def hop_key(label: Column) -> Column:
    t = F.trim(label)
    return F.when(single_integer(t), F.concat(F.lit("hop"), t)).otherwise(F.concat(F.lit("label:"), t))


def trim_numeric_noise(text: Column, most: int = 48) -> Column:
    """Words and numbers of a text, numbers dropped, the first few joined by spaces."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?"), 0)
    return F.array_join(F.slice(F.filter(found, lambda t: ~t.rlike("^[0-9]")), 1, most), " ")


# The features that the two noisy domains drop, and the words that the others keep at most.
BOOK_DROPS = ("popular_shelves", "num_pages", "publication_year", "isbn", "isbn13", "publication_month", "publication_day")
BOOK_WORDS = {"title": 64, "description": 96}
BOOK_PLAIN = ("language_code", "country_code", "format", "is_ebook")
BOOK_REST, BOOK_GENRES = 32, 8
MEDICAL_DROPS = ("id", "identifier", "mesh_id", "omim_id", "doid", "umls", "entrez", "tax_id", "drugbank_id", "inchi", "inchikey", "pubchem", "pubmed", "pmid")
MEDICAL_LONG, MEDICAL_WORDS, MEDICAL_REST, MEDICAL_NAME = ("name", "title", "description", "definition"), 64, 24, 32


def sanitized_features(features: Column, domain: Column) -> Column:
    """A node's features (name to text, lists as JSON) without noise: names of records, counts and numbers go.

    The book domain keeps up to eight genres as a list and plain codes as they are; the medical domain falls back to
    the name if nothing is left. Other domains keep all.
    """
    some = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    def genres(v: Column) -> Column:
        own = F.filter(F.transform(F.slice(F.from_json(v, "array<string>"), 1, BOOK_GENRES), stripped), lambda x: x != "")
        return F.array_join(own, ", ")

    def book(k: Column, v: Column) -> Column:
        out = F.when(k.isin(*BOOK_DROPS), F.lit(None).cast("string"))
        for name, most in BOOK_WORDS.items():
            out = out.when(k == name, trim_numeric_noise(v, most))
        out = out.when((k == "genres") & v.startswith("[") & F.from_json(v, "array<string>").isNotNull(), genres(v))
        return out.when(k.isin(*BOOK_PLAIN), stripped(v)).otherwise(trim_numeric_noise(v, BOOK_REST))

    def medical(k: Column, v: Column) -> Column:
        gone = k.isin(*MEDICAL_DROPS) | k.endswith("_id")
        return F.when(gone, F.lit(None).cast("string")).when(k.isin(*MEDICAL_LONG), trim_numeric_noise(v, MEDICAL_WORDS)).otherwise(trim_numeric_noise(v, MEDICAL_REST))

    books, medicine = some(F.transform_values(features, book)), some(F.transform_values(features, medical))
    name = F.try_element_at(features, F.lit("name"))
    fallback = some(F.create_map(F.lit("name"), trim_numeric_noise(F.coalesce(name, F.lit("")), MEDICAL_NAME)))
    medicine = F.when((F.size(medicine) == 0) & F.map_contains_key(features, "name"), fallback).otherwise(medicine)
    d = F.lower(domain)
    return F.when(d == "goodreads", books).when(d == "biomedical", medicine).otherwise(features)


def flattened(features: Column) -> Column:
    """name: value; name: value."""
    return F.array_join(F.transform(F.map_entries(features), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def keywords(text: Column) -> Column:
    """The keywords of a list: label, brackets, numbering and quotes stripped."""
    x = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(answer|keywords?)\s*:\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^[\[\]{}() ]+", ""), r"[\[\]{}() ]+$", "")
    piece = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\s*\d+[\).\-:]\s*", ""), "^[ \"']+", ""), "[ \"']+$", "")
    return F.filter(F.transform(F.split(x, r"[,;\n|]+"), piece), lambda p: p != "")


def keyword_match(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def topic_scores(pred: Column, label: Column) -> tuple[Column, Column, Column]:
    """exact, f1, recall of a keyword answer."""
    p, g = (F.transform(keywords(x), normalize) for x in (pred, label))
    hit = F.size(F.filter(g, lambda y: F.exists(p, lambda x: keyword_match(x, y))))
    n = F.size(g)
    recall = F.when(n > 0, hit / F.greatest(n, F.lit(1))).otherwise(0.0)
    return F.when((n > 0) & (hit == n), 1.0).otherwise(0.0), F.when(n > 0, token_f1(pred, label)).otherwise(0.0), recall


def witness_scores(pred: Column, label: Column, path: Column, meta_witness: Column) -> tuple[Column, Column]:
    """answer accuracy and witness validity of a path answer."""
    p, q = F.trim(F.coalesce(pred, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    inner = F.when(F.size(path) > 2, F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    valid = F.array_append(F.coalesce(inner, F.array().cast("array<string>")), F.coalesce(F.trim(meta_witness), F.lit("")))
    pattern = r"(?i)^\s*yes(?:[\t, ]+(.+?))?\s*$"
    yes, who = p.rlike(pattern), F.trim(F.regexp_extract(p, pattern, 1))
    none = (q == "no_path")
    ok = (p == "no_path").cast("double")
    return F.when(none, ok).otherwise(yes.cast("double")), F.when(none, ok).otherwise((yes & (who != "") & F.array_contains(valid, who)).cast("double"))


def clean_tags_first(text: Column) -> Column:
    """Generated text without tags, cut at end tokens, instruction marks and code fences."""
    x = F.trim(F.regexp_replace(text, "<[^>]+>", ""))
    return _cut(x)


def _cut(x: Column) -> Column:
    for mark in (r"</s>|<\|eot_id\|>|<\|end_of_text\|>", r"\[/?INST\]"):
        x = F.trim(F.get(F.split(x, mark, 2), F.lit(0)))
    x = F.trim(F.regexp_replace(x, r"(?i)\]\s*\(?/?INST\)?", ""))
    return F.trim(F.get(F.split(x, "```", 2), F.lit(0)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_tags_last(text: Column) -> Column:
    """Generated text up to the first end token, instruction mark or code fence; only what is left loses its tags."""
    for mark in (r"</s>|<\|eot_id\|>|<\|end_of_text\|>", r"\[/?INST\]", "```"):
        text = stripped(F.get(F.split(text, mark, 2), F.lit(0)))
    return stripped(F.regexp_replace(stripped(F.regexp_replace(text, "<[^>]+>", "")), r"(?i)\][\s]*\(?/?INST\)?", ""))


def legal_integer(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """The first whole number of a text, else the text; with bounds a number outside them is empty."""
    found = F.regexp_extract(text, "-?[0-9]+", 0)
    if least is None:
        return F.when(found == "", text).otherwise(found)
    low, high = sorted((least, least if most is None else most))
    number = found.try_cast("decimal(38,0)")
    return F.when(found == "", text).when(number.between(low, high), number.cast("string")).otherwise("")


def keyword_list(text: Column, most: int = 3) -> Column:
    x = F.trim(F.regexp_replace(text, r"(?i)^(answer|keywords?)\s*:\s*", ""))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\\[\\]{}\"']", ""), r"\s*[\r\n]+\s*", ", "), r"\s*;\s*", ", ")
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(F.regexp_replace(p, r"^\s*\d+[\).\-:]\s*", ""))), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, most), ", ")).otherwise(x)


def format_compliant(pred: Column) -> Column:
    p = F.coalesce(pred, F.lit(""))
    obj = F.trim(p).startswith("{") & (F.get_json_object(p, "$.answer").isNotNull() | F.get_json_object(p, "$.path").isNotNull())
    return obj | p.rlike("(?i)[\"']?(answer|path)[\"']?\\s*:")


def hopwise_accuracy(pred: Column, gold: Column) -> Column:
    """Share of positions after the first that agree; null without two gold nodes or a predicted path."""
    at = F.sequence(F.lit(1), F.greatest(F.size(gold) - 1, F.lit(1)))
    same = F.size(F.filter(at, lambda i: F.get(pred, i) == F.get(gold, i)))
    return F.when(pred.isNotNull() & (F.size(gold) >= 2), same / F.greatest(F.size(gold) - 1, F.lit(1)))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_bool(text: Column) -> Column:
    x = F.lower(F.trim(text))
    return F.when(x.isin("1", "true", "yes", "y", "on"), True).when(x.isin("0", "false", "no", "n", "off"), False)


# The features that name a node, the first that has a text counts.
DISPLAY_KEYS = ("name", "title", "label", "term", "display_name")


def display_name(features: Column, node_type: Column, node_id: Column) -> Column:
    """A node's name and type by its features (a JSON object), or its type and id where none of the texts names it."""
    named = F.from_json(features, "map<string,variant>")

    def text(key: str) -> Column:
        v = F.try_element_at(named, F.lit(key))
        x = F.when(F.schema_of_variant(v) == "STRING", stripped(F.try_variant_get(v, "$", "string")))
        return F.when(x != "", x)

    label = F.coalesce(*map(text, DISPLAY_KEYS), node_id)
    return F.when(label == node_id, F.concat(node_type, F.lit(":"), node_id)).otherwise(F.concat(label, F.lit(" ("), node_type, F.lit(")")))
