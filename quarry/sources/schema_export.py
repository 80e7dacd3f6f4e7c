"""Nested XML schema exports as a DataFrame of tables: one row for each, with its fields, key and stamps.

An export names its file on the root element, pairs a reference to a base table with the list
of its fields that follows it, and keeps the comments of tables in another part. A file is
parsed by the task that reads its bytes, so a folder of exports is read in parallel.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the export format.
ROOT = "FMSaveAsXML"
TABLE, REFERENCE, LIST, FIELD = "BaseTable", "BaseTableReference", "ObjectList", "Field"
SERIAL, MODIFIED, CREATED, CALCULATED = "SerialNumber", "ModificationTimestamp", "CreationTimestamp", "Calculated"
UNNAMED = "unknown.fmp12"

SCHEMA = "file string, table string, comment string, key string, key_kind string, modified string, created string, fields array<struct<name:string,type:string,kind:string,comment:string,stored:boolean,global:boolean>>"

_KEY_WORD = re.compile(r"(?<![a-z])(id|uuid|pk|key|serial)(?![a-z])", re.IGNORECASE)
_UUID_CALL = re.compile(r"Get\s*\(\s*UUID", re.IGNORECASE)


def _field(e: ET.Element) -> dict:
    """What a field's element tells: its own attributes, and those of the parts below it."""
    enter, check, storage = (next(e.iter(tag), ET.Element(tag)) for tag in ("AutoEnter", "Validation", "Storage"))
    stored = any(k == "storeCalculationResults" and v.lower() == "true" for part in e.iter() for k, v in part.items())
    calls = any(_UUID_CALL.search(part.text or "") or any(map(_UUID_CALL.search, part.attrib.values())) for part in e.iter())
    return {
        "name": e.get("name", ""), "type": e.get("datatype", ""), "kind": e.get("fieldtype", ""), "comment": e.get("comment") or None, "enter": enter.get("type", ""),
        "unique": check.get("unique") == "True", "filled": check.get("notEmpty") == "True", "global": storage.get("global") == "True",
        "uuid": enter.get("type") == CALCULATED and calls, "stored": e.get("fieldtype") == CALCULATED and stored,
    }


def choose_key(fields: list[dict]) -> tuple[str | None, str | None]:
    """The key and how it is known: a serial number, a unique field that is never empty, a UUID named like a key, any
    unique field. Of serials, and of unique fields never empty, one named like a key goes first; then the first one."""
    ranked = []
    for place, f in enumerate(fields):
        named = bool(_KEY_WORD.search(f["name"]))
        if f["enter"] == SERIAL:
            ranked.append((0, not named, place, f["name"], "serial"))
        elif f["unique"] and f["filled"]:
            ranked.append((1, not named, place, f["name"], "unique"))
        elif f["uuid"] and named:
            ranked.append((2, False, place, f["name"], "uuid"))
        elif f["unique"]:
            ranked.append((3, False, place, f["name"], "unique"))
    return min(ranked)[3:] if ranked else (None, None)


def parse(content: bytes) -> list[tuple]:
    """The rows of SCHEMA of one export. A table listed twice counts once, as first listed; one without fields not at all."""
    root = ET.fromstring(content)
    if root.tag.lower() != ROOT.lower():
        raise ValueError(f"not a schema export: its root is {root.tag}")
    comments = {e.get("name"): e.get("comment", "").strip() for e in root.iter(TABLE) if e.get("comment", "").strip()}
    out: dict[str, tuple] = {}
    for parent in root.iter():
        for ref, listed in zip(parent, parent[1:], strict=False):
            if (ref.tag, listed.tag) != (REFERENCE, LIST) or not ref.get("name") or ref.get("name") in out:
                continue
            found = [_field(e) for e in listed.findall(FIELD)]
            if not found:
                continue
            fields = [f for f in found if f["name"]]
            stamps = [f for f in fields if f["enter"] == MODIFIED]
            modified = next((f["name"] for f in sorted(stamps, key=lambda f: "timestamp" not in f["type"].lower())), None)
            created = next((f["name"] for f in fields if f["enter"] == CREATED), None)
            told = [tuple(f[k] for k in ("name", "type", "kind", "comment", "stored", "global")) for f in fields]
            out[ref.get("name")] = (root.get("File") or UNNAMED, ref.get("name"), comments.get(ref.get("name")), *choose_key(fields), modified, created, told)
    return list(out.values())


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The tables of every export under path, whatever its encoding. A file that is no export is an error."""
    tables = F.udf(lambda content: parse(content), f"array<struct<{SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")
    return spark.read.format("binaryFile").load(path).select(F.explode(tables("content")).alias("t")).select("t.*")


def merge_exports(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """held, in which the tables of every file of fresh are replaced by those of fresh."""
    return held.join(fresh.select("file").distinct(), "file", "left_anti").select(*fresh.columns).unionByName(fresh)
