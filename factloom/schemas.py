"""Fixed schemas and the ontology's constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FACTS = "type string, name string, fact string, evidence string, score double, accepted boolean"
CHUNKS = (
    "source string, idx int, parent_id string, parent_len int, chunk_size_tokens int, chunk_overlap_tokens int, "
    "chunk_index int, chunk_start int, chunk_end int, page_content string"
)
NODES = "chunk_id long, pos long, id string, label string, name string"
RELS = "chunk_id long, pos long, src_id string, rtype string, tgt_id string"

# Labels, relation types, allowed triples, fact templates, category hints, score bands.
LABELS = ["Person", "Organization", "Product", "Location", "City", "Country", "Government Body", "Year"]
ALLOWED_TRIPLES = [
    ("Person", "WORKS_FOR", "Organization"),
    ("Person", "FOUNDED", "Organization"),
    ("Organization", "ACQUIRED", "Organization"),
    ("Organization", "LOCATED_IN", "Location"),
    ("Person", "AFFILIATED_WITH", "Organization"),
    ("Organization", "COMPETES_WITH", "Organization"),
    ("Product", "MADE_BY", "Organization"),
    ("Organization", "PARTNERED_WITH", "Organization"),
    ("Product", "COMPETES_WITH", "Product"),
]
ENTITY_TEMPLATES = {
    "Person": "is a person",
    "Organization": "is an organization",
    "Product": "is a product",
    "Location": "is a location",
    "City": "is a city",
    "Country": "is a country",
    "Government Body": "is a government body",
    "Year": "is a year",
}
RELATION_PHRASES = {
    "WORKS_FOR": "works for",
    "FOUNDED": "founded",
    "ACQUIRED": "acquired",
    "LOCATED_IN": "is located in",
    "AFFILIATED_WITH": "is affiliated with",
    "COMPETES_WITH": "competes with",
    "MADE_BY": "is made by",
    "PARTNERED_WITH": "partnered with",
}
CATEGORY_HINTS = {
    "Organization": "Companies",
    "Product": "Products",
    "Person": "People",
    "Country": "Countries",
    "Government Body": "Government bodies",
    "Location": "Places",
}
SCORE_BANDS = [(-0.5, "Very Low"), (-0.25, "Low"), (0.0, "Uncertain (−)"), (0.25, "Uncertain (+)"), (0.5, "Moderate High"), (1.0, "Very High")]


def entity_templates(spark: SparkSession, templates: dict[str, str] = ENTITY_TEMPLATES) -> DataFrame:
    """label, template: the verb phrase that follows an entity's name."""
    return spark.createDataFrame(list(templates.items()), "label string, template string")


def relation_templates(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """rtype and the template's parts around its two placeholders.

    Kept in parts so that names which themselves hold a placeholder stay as they are.
    """
    templates = templates or {r: "{src} " + p + " {tgt}." for r, p in RELATION_PHRASES.items()}
    rows = []
    for rtype, t in templates.items():
        before, _, rest = t.partition("{src}")
        middle, _, after = rest.partition("{tgt}")
        rows.append((rtype, before, middle, after))
    return spark.createDataFrame(rows, "rtype string, prefix string, infix string, suffix string")


def ontology(spark: SparkSession) -> DataFrame:
    """src_label, rtype, tgt_label of the allowed relations."""
    return spark.createDataFrame(ALLOWED_TRIPLES, "src_label string, rtype string, tgt_label string")


def canonical_label(label):
    """A label in the ontology's spelling, whatever its case; others stay as they are."""
    out = label
    for known in LABELS:
        out = F.when(F.lower(label) == known.lower(), F.lit(known)).otherwise(out)
    return out


#: The names under which judges give the three verdicts, normalised to one vocabulary.
VERDICTS = {
    "entailment": "entailed",
    "entailed": "entailed",
    "contradiction": "contradicted",
    "contradicted": "contradicted",
    "neutral": "unknown",
    "unknown": "unknown",
}


def endpoint_id(df: DataFrame, column: str):
    """The id of a relation's end given as a struct with an ``id``, as JSON text of such an object, or as the bare id."""
    kind = df.schema[column].dataType
    if hasattr(kind, "fieldNames"):
        return F.col(f"{column}.id")
    inner = F.get_json_object(F.col(column), "$.id")
    return F.when(F.ltrim(F.col(column)).startswith("{"), F.coalesce(inner, F.col(column))).otherwise(F.col(column))
