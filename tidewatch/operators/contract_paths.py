"""Contract checks of whole JSON documents: unknown fields at any depth, array bounds and types.

A document is parsed to a variant and unfolded level by level into one row per place, named by its path
(``.entities[].mentions[].role``). Every place is looked up among the contract's paths: a path that the contract
lacks is an unknown field, an array with more items than its path allows is out of bounds, a value of another kind is of
the wrong type. Only declared objects and arrays are unfolded further, so the levels are bounded by the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.staging import materialize

# The fields of a detail artifact and of the index, by their kind. ``?`` allows null; a number bounds an array.
_TARGET = {"eventUid": "string", "eventRevisionUid": "string", "eventId": "integer?", "title": "string", "publishedAt": "integer?",
           "locationLabel": "string?", "sourceUrls": (5, "string")}
_REASON = {"code": "string", "entityUid": "string", "evidenceUids": (4, "string"), "label": "string"}
_MENTION = {"mentionUid": "string", "evidenceUid": "string", "role": "string", "field": "string", "rawText": "string", "start": "integer?",
            "end": "integer?", "methodVersion": "string"}
_EVIDENCE = {"evidenceUid": "string", "sourceUid": "string", "sourceRevisionUid": "string", "eventRevisionUids": (6, "string"), "providerUid": "string",
             "sourceUrl": "string", "title": "string", "publishedAt": "integer?", "observedAt": "integer", "excerpt": "string?",
             "evidenceKind": "string", "reportingOriginUid": "string?", "independence": "string", "status": "string"}
_ENTITY = {"entityUid": "string", "kind": "string", "canonicalValue": "string", "displayName": "string", "resolution": "string", "mentions": (5, _MENTION)}
_ENTRY = {"entryUid": "string", "kind": "string", "observedAt": "integer", "sourcePublishedAt": "integer?", "eventRevisionUid": "string",
          "label": "string", "evidenceUids": (5, "string")}
_EDGE = {"edgeUid": "string", "kind": "string", "target": _TARGET, "reasons": (3, _REASON), "methodVersion": "string"}
DETAIL = {"schemaVersion": "any", "releaseUid": "string", "eventUid": "string", "eventRevisionUid": "string", "projectionHash": "string",
          "generatedAt": "integer", "evidence": (20, _EVIDENCE), "entities": (20, _ENTITY), "timeline": (20, _ENTRY), "related": (5, _EDGE),
          "truncated": {"evidence": "boolean", "entities": "boolean", "timeline": "boolean", "related": "boolean"}}
INDEX = {"schemaVersion": "any", "releaseUid": "string", "generatedAt": "integer", "snapshotHash": "string",
         "entries": (500, {"eventId": "integer", "eventUid": "string", "eventRevisionUid": "string", "projectionHash": "string", "artifactPath": "string"})}

#: Kinds of a parsed value, by the beginning of its type's name.
_KINDS = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BIGINT", "integer"), ("BOOLEAN", "boolean"), ("VOID", "null"))

_RULE = (("wanted", "string"), ("nullable", "boolean"), ("most", "int"))


def contract_rows(contract: dict | tuple | str, path: str = "") -> list[tuple[str, str, bool, int | None]]:
    """(path, kind, nullable, most items) of every place a contract declares."""
    if isinstance(contract, str):
        return [(path, contract.rstrip("?"), contract.endswith("?"), None)]
    if isinstance(contract, tuple):
        return [(path, "array", False, contract[0]), *contract_rows(contract[1], f"{path}[]")]
    return [(path, "object", False, None), *(row for name, x in contract.items() for row in contract_rows(x, f"{path}.{name}"))]


def contract_violations(documents: DataFrame, key: str, payload: str, contract: dict) -> DataFrame:
    """(key, path, rule) of every broken rule, once per document: not_json, unknown_field, array_bound, wrong_type.

    One chain of narrow steps: a document is parsed once, and each step judges and unfolds the places that the last one found. A place that
    keeps to the contract ends there; only its fields or items and broken rules go on.
    """
    declared = contract_rows(contract)
    # As many entries as the contract has places.
    rules = F.create_map(*(x for path, *rule in declared for x in (F.lit(path), F.struct(*(F.lit(r).cast(t).alias(n) for r, (n, t) in zip(rule, _RULE))))))
    found = documents.select(F.col(key).alias("doc"), F.lit("").alias("path"), F.try_parse_json(payload).alias("v"), F.lit(None).cast("string").alias("rule"))
    for _ in range(max(path.count(".") + path.count("[]") for path, *_ in declared) + 1):
        now = F.col("rule").isNull()
        read = lambda shape: F.when(now, F.try_variant_get("v", "$", shape))  # noqa: E731, B023
        opened = materialize(found, {"fields": F.map_entries(read("map<string,variant>")), "list": read("array<variant>"), "c": F.when(now, F.try_element_at(rules, F.col("path")))})
        plain = now & F.col("fields").isNull() & F.col("list").isNull()
        told = materialize(opened, {"told": F.when(plain, F.schema_of_variant("v"))})
        kind = F.when(F.col("fields").isNotNull(), "object").when(F.col("list").isNotNull(), "array").when(F.col("v").isNull(), "broken")
        for start, name in _KINDS:
            kind = kind.when(F.col("told").startswith(start), name)
        judged = materialize(told, {"kind": F.when(now, kind.otherwise("number"))})
        fits = (F.col("kind") == F.col("c.wanted")) | (F.col("c.wanted") == "any") | (F.col("c.nullable") & (F.col("kind") == "null"))
        rule = (
            F.when(~now, F.col("rule")).when(F.col("kind") == "broken", "not_json").when(F.col("c").isNull(), "unknown_field")
            .when(~fits, "wrong_type").when(F.size("list") > F.col("c.most"), "array_bound")
        )
        place = lambda path, v, rule: F.struct(path.alias("path"), v.alias("v"), rule.alias("rule"))
        none = F.lit(None).cast("string")
        below = F.when(F.col("c.wanted").isin("object", "array"), F.coalesce(
            F.transform("fields", lambda x: place(F.concat("path", F.lit("."), x["key"]), x["value"], none)),  # noqa: B023
            F.transform("list", lambda x: place(F.concat("path", F.lit("[]")), x, none))))  # noqa: B023
        itself = F.filter(F.array(place(F.col("path"), F.lit(None).cast("variant"), rule)), lambda x: x["rule"].isNotNull())
        found = judged.select("doc", F.inline(F.when(below.isNull(), itself).otherwise(F.concat(itself, below))))
    return found.filter("rule IS NOT NULL").select(F.col("doc").alias(key), "path", "rule").distinct()
