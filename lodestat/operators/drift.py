"""Schemas that drift between files.

Each file gets a fingerprint of its fields and their types; the files of one path, in the order they were written,
make versions of a schema.  Only where a fingerprint differs from the one before are both payloads compared,
which yields explicit migration steps (rename, add, remove, cast).  The steps found in all files
make a registry; each file is routed through its rename, default and cast rules into one table, and every rule that was applied is recorded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.ordered import previous_row
from lodestat.operators.ranked import cumulative

#: Keys that name a record within its list.
RECORD_KEYS = ("claim_id", "source_id", "source_text")
#: Distinct field names of one list that the registry may hold; beyond it names are data, not a schema.
MAX_FIELD_NAMES = 100_000

CHANGE = "array<struct<change_kind:string,field_before:string,field_after:string,types_before:string,types_after:string>>"


class _Number(str):
    """A number as it is written in the file."""


def _parse(payload: str | None) -> dict | None:
    """The JSON object of a file, or None if it is none."""
    if payload is None:
        return None
    try:
        doc = json.loads(payload, parse_float=_Number, parse_int=_Number, parse_constant=_Number)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def _kind(value) -> str:
    if isinstance(value, _Number):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "array" if isinstance(value, list) else "object"


def _text(value) -> str | None:
    """A value as text: strings bare, else as JSON."""
    if value is None:
        return None
    if isinstance(value, str):
        return str(value)
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _plain(value):
    if isinstance(value, _Number):
        try:
            return json.loads(value)
        except ValueError:
            return str(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _sections(doc: dict, rest: bool = False) -> dict[str, list[dict]]:
    """The records of each list; ``meta`` is a list of one.

    With ``rest`` nothing is left out: other fields of the file are the one record of ``file``, and entries that are no objects have one field ``value``.
    """
    out: dict[str, list[dict]] = {}
    loose = {}
    for name, value in doc.items():
        if name == "meta" and isinstance(value, dict):
            out[name] = [value]
        elif name != "meta" and isinstance(value, list):
            out[name] = [r if isinstance(r, dict) else {"value": r} for r in value if rest or isinstance(r, dict)]
        else:
            loose[name] = value
    if rest and loose:
        out["file"] = [*out.get("file", []), loose]
    return out


def _types(records: list[dict]) -> dict[str, frozenset[str]]:
    kinds: dict[str, set[str]] = defaultdict(set)
    for r in records:
        for k, v in r.items():
            if v is None:
                kinds[k]
            else:
                kinds[k].add(_kind(v))
    return {k: frozenset(v) for k, v in kinds.items()}


def fingerprint(payload: str | None) -> str | None:
    """A digest of the fields and types of a file, the same for files of the same schema."""
    doc = _parse(payload)
    if doc is None:
        return None
    schema = {s: {k: sorted(t) for k, t in _types(rs).items()} for s, rs in _sections(doc).items()}
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()


def _keyed(section: str, records: list[dict]) -> dict[tuple, dict]:
    """Records by their key and its how-manieth use."""
    if section == "meta":
        return {("meta", 0): r for r in records}
    out, used = {}, defaultdict(int)
    for r in records:
        key = next(((k, _text(r[k])) for k in RECORD_KEYS if r.get(k) is not None), None)
        if key is not None:
            out[(*key, used[key])] = r
            used[key] += 1
    return out


def changes(before: str | None, after: str | None) -> list[dict]:
    """The migration steps from one file to the next."""
    a, b = _parse(before), _parse(after)
    if a is None or b is None:
        return []
    old, new = _sections(a), _sections(b)
    out = []
    for section in sorted({*old, *new}):
        ra, rb = old.get(section, []), new.get(section, [])
        ta, tb = _types(ra), _types(rb)
        gone, come = sorted(ta.keys() - tb.keys()), sorted(tb.keys() - ta.keys())
        pairs = {k: k for k in ta.keys() & tb.keys()}
        steps = [(k, k) for k in sorted(pairs)]
        if gone and come:
            ka, kb = _keyed(section, ra), _keyed(section, rb)
            shared = [(ka[k], kb[k]) for k in ka.keys() & kb.keys()]
            renamed = [(g, c) for g in gone for c in come if _same(shared, g, c)]
            for g, c in renamed:
                out.append(("renamed", section, g, c, ta[g], tb[c]))
            steps += renamed
            gone = [g for g in gone if all(g != x for x, _ in renamed)]
            come = [c for c in come if all(c != x for _, x in renamed)]
        out += [("removed", section, g, "", ta[g], frozenset()) for g in gone]
        out += [("added", section, "", c, frozenset(), tb[c]) for c in come]
        out += [("retyped", section, x, y, ta[x], tb[y]) for x, y in steps if ta[x] and tb[y] and ta[x] != tb[y]]
    return [
        {
            "change_kind": kind,
            "field_before": f"{s}.{x}" if x else "",
            "field_after": f"{s}.{y}" if y else "",
            "types_before": ",".join(sorted(tx)),
            "types_after": ",".join(sorted(ty)),
        }
        for kind, s, x, y, tx, ty in out
    ]


def _same(shared: list[tuple[dict, dict]], old: str, new: str) -> bool:
    some = False
    for a, b in shared:
        x, y = _text(a.get(old)), _text(b.get(new))
        if x != y:
            return False
        some |= x is not None
    return some


def _fingerprints(payload: pd.Series) -> pd.Series:
    return payload.map(fingerprint, na_action="ignore")


def _change_lists(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([changes(a, b) for a, b in zip(before, after)])


def file_versions(files: DataFrame) -> DataFrame:
    """One row for each file: file_id, path, written_at, digest of the payload, fingerprint, prev<file_id, digest, fingerprint>.

    Of deliveries of a file that differ the one written first counts, then that of the smaller digest.
    """
    each = files.where(F.col("file_id").isNotNull()).select(
        "file_id", "path", "written_at", F.xxhash64("payload").alias("digest"), F.pandas_udf(_fingerprints, "string")("payload").alias("fingerprint")
    )
    skinny = each.groupBy("file_id").agg(F.min(F.struct("written_at", "digest", "path", "fingerprint")).alias("__f"))
    return previous_row(
        skinny.select("file_id", "__f.path", "__f.written_at", "__f.digest", "__f.fingerprint"), by="path", order=["written_at", "file_id"],
        carry=["file_id", "digest", "fingerprint"], slice_of=F.date_trunc("day", F.col("written_at").cast("timestamp")),
    )


def file_changes(files: DataFrame) -> DataFrame:
    """Every change of every file against the one of the same path written before it.

    Gives file_id, change_kind, field_before, field_after, types_before, types_after.

    A file delivered twice counts once; files of equal time are ordered by file_id.  Files without
    an id are left out; a null path is a path of its own.  A payload that is null or no JSON object
    has no fields to compare, so neither it nor its successor reports changes.  Records without a
    key take part in the fields but not in the comparison of values; repeated keys are paired in order.

    Scale: payloads are read twice.  Fingerprints are made where they are read, and repeated deliveries are folded on narrow rows;
    only payloads of files whose fingerprint changed, and of their predecessors, are handed on.  The order of a
    path is found in daily slices on narrow rows.
    """
    changed = file_versions(files).where(F.col("prev").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("prev.fingerprint")))
    pairs = changed.select("file_id", "digest", F.col("prev.file_id").alias("prev_id"), F.col("prev.digest").alias("prev_digest"))
    wanted = pairs.select(F.inline(F.array(F.struct(F.col("file_id").alias("fid"), F.col("digest").alias("__h")), F.struct(F.col("prev_id").alias("fid"), F.col("prev_digest").alias("__h"))))).distinct()
    once = files.select(F.col("file_id").alias("fid"), F.xxhash64("payload").alias("__h"), "payload").join(wanted, ["fid", "__h"], "left_semi").dropDuplicates(["fid", "__h"])
    both = (
        pairs.join(once.select(F.col("fid").alias("file_id"), F.col("__h").alias("digest"), F.col("payload").alias("after")), ["file_id", "digest"])
        .join(once.select(F.col("fid").alias("prev_id"), F.col("__h").alias("prev_digest"), F.col("payload").alias("before")), ["prev_id", "prev_digest"])
    )
    return both.select("file_id", F.inline(F.pandas_udf(_change_lists, CHANGE)("before", "after")))


def schema_versions(files: DataFrame) -> DataFrame:
    """The versions of the schema of each path: path, version (from 1), fingerprint, first_file, n_files, steps.

    A version lasts as long as files of the path, in the order they were written, keep their fingerprint; ``steps`` are the sorted changes
    (change_kind, field_before, field_after) that lead to it, empty for the first.

    Scale: versions are numbered by sums over ranges of narrow rows, so no path's files meet in one task.
    """
    each = file_versions(files)
    starts = F.col("prev").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("prev.fingerprint"))
    marked = each.select("path", F.col("written_at").cast("timestamp").alias("written_at"), "file_id", "fingerprint", starts.cast("int").alias("__new"))
    numbered = cumulative(marked, ["path"], ["written_at", "file_id"], "__new").withColumn("version", (F.col("before") + F.col("__new")).cast("int"))
    versions = numbered.groupBy("path", "version").agg(
        F.min("fingerprint").alias("fingerprint"), F.min_by("file_id", F.struct("written_at", "file_id")).alias("first_file"), F.count("*").alias("n_files")
    )
    steps = file_changes(files).groupBy(F.col("file_id").alias("first_file")).agg(F.array_sort(F.collect_set(F.struct("change_kind", "field_before", "field_after"))).alias("steps"))
    none = F.array().cast(steps.schema["steps"].dataType)
    return versions.join(steps, "first_file", "left").select("path", "version", "fingerprint", "first_file", "n_files", F.coalesce("steps", none).alias("steps"))


def registry(changed: DataFrame) -> list[tuple[str, str, str]]:
    """The rename rules (section, name, canonical name) from all changes.

    Names that renames connect are one field; its canonical name is the one most renames lead from,
    then the first in the alphabet.  The rules are as many as there are distinct field names, which is
    checked against MAX_FIELD_NAMES.
    """
    steps = changed.where(F.col("change_kind") == "renamed").groupBy("field_before", "field_after").agg(F.count("*").alias("n"))
    rows = steps.limit(MAX_FIELD_NAMES + 1).collect()
    if len(rows) > MAX_FIELD_NAMES:
        raise ValueError(f"more than {MAX_FIELD_NAMES} distinct renames: these names are data, not a schema")
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    weight: dict[str, int] = defaultdict(int)
    for r in rows:
        root[find(r.field_before)] = find(r.field_after)
        weight[r.field_before] += r.n
    groups = defaultdict(list)
    for x in root:
        groups[find(x)].append(x)
    out = []
    for names in groups.values():
        best = min(names, key=lambda x: (-weight[x], x))
        out += [(n.split(".", 1)[0], n.split(".", 1)[1], best.split(".", 1)[1]) for n in names if n != best]
    return sorted(out)


def _field_kinds(payload: pd.Series) -> pd.Series:
    """The fields of files with their types and how often each occurs."""
    out = []
    for p in payload:
        counts: dict[tuple[str, str, str], int] = defaultdict(int)
        for section, records in _sections(_parse(p) or {}, rest=True).items():
            for r in records:
                for name, value in r.items():
                    if value is not None:
                        counts[section, name, _kind(value)] += 1
        out.append([{"section": s, "name": n, "kind": k, "n": c} for (s, n, k), c in counts.items()])
    return pd.Series(out)


def cast_value(value, target: str) -> tuple[object, list[str]] | None:
    """A value as the target type, and the casts that lead there; None if no rules do.

    Arrays and objects of one member become that member, numbers and booleans text, text the number or boolean that it says, and a
    single value an array of one.
    """
    steps: list[str] = []
    while _kind(value) != target:
        kind = _kind(value)
        if kind == "array" and len(value) == 1 and value[0] is not None:
            value = value[0]
        elif kind == "object" and len(value) == 1 and next(iter(value.values())) is not None:
            value = next(iter(value.values()))
        elif target == "string" and kind in ("number", "boolean"):
            value = str(_text(value))
        elif target == "number" and kind == "string" and _IS_NUMBER.fullmatch(value):
            value = _Number(value)
        elif target == "boolean" and kind == "string" and value in ("true", "false"):
            value = value == "true"
        elif target == "array" and kind != "object":
            value = [value]
        else:
            return None
        steps.append(f"{kind}>{_kind(value)}")
    return value, steps


def consistent_records(files: DataFrame) -> DataFrame:
    """All records of all files in one table, under canonical field names and types.

    Gives file_id, path, section, record_no, record_key, field, field_before, value, kind, rule.  ``field`` is the canonical name,
    ``field_before`` the name in the file, ``value`` the value as text, ``kind`` its JSON type, and ``rule`` the chain of rules that led there:
    ``kept``, or ``renamed``, ``collision`` (the file has two names of one field: one keeps its place, the others their own names), ``cast a>b``, or
    ``uncast a`` where no rule leads to the field's type, which is the most frequent one of the field over all files.  A field that the section
    has elsewhere but this file's version has not gets one row with ``default``, null and no record.

    A file delivered twice counts once.  Payloads that are null or no JSON object give no rows; null values and fields missing in single records
    are left out.  Other fields of a file than its meta and lists are the section ``file``, entries that are no objects have the field ``value``.

    Scale: payloads are folded by (file, digest) once; the registry, at most MAX_FIELD_NAMES renames and fields, is all that the driver sees.
    """
    chosen = file_versions(files).select("file_id", "path", F.col("digest").alias("__h"))
    once = files.select("file_id", F.xxhash64("payload").alias("__h"), "payload").join(chosen, ["file_id", "__h"]).dropDuplicates(["file_id", "__h"])
    rules = {(s, n): c for s, n, c in registry(file_changes(files))}
    kinds = "array<struct<section:string,name:string,kind:string,n:bigint>>"
    counted = files.where(F.col("file_id").isNotNull()).select(F.inline(F.pandas_udf(_field_kinds, kinds)("payload"))).groupBy("section", "name", "kind").agg(F.sum("n").alias("n"))
    listed = counted.limit(MAX_FIELD_NAMES + 1).collect()
    if len(listed) > MAX_FIELD_NAMES:
        raise ValueError(f"more than {MAX_FIELD_NAMES} distinct fields: these names are data, not a schema")
    weight: dict[tuple[str, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for r in listed:
        weight[r.section, rules.get((r.section, r.name), r.name)][r.kind] += r.n
    main = {f: max(sorted(k), key=lambda x: k[x]) for f, k in weight.items()}
    fields_of: dict[str, list[str]] = defaultdict(list)
    for section, field in sorted(main):
        fields_of[section].append(field)

    def route(section: str, records: list[dict]) -> dict[str, tuple[str, str]]:
        """The canonical name of each field of a file, and the rule."""
        names = sorted({n for r in records for n in r})
        out: dict[str, tuple[str, str]] = {}
        taken: dict[str, str] = {}
        for n in sorted(names, key=lambda n: (rules.get((section, n), n) != n, n)):  # who has the canonical name comes first
            to = rules.get((section, n), n)
            out[n] = (n, "collision") if to in taken else (to, "renamed" if to != n else "")
            taken.setdefault(to, n)
        return out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, path, payload in zip(batch.file_id, batch.path, batch.payload):
                for section, records in _sections(_parse(payload) or {}, rest=True).items():
                    routes = route(section, records)
                    here = {to for to, _ in routes.values()}
                    out += [(file_id, path, section, None, None, f, None, None, main[section, f], "default") for f in fields_of[section] if f not in here]
                    for no, r in enumerate(records):
                        key = next((_text(r[k]) for k in RECORD_KEYS if r.get(k) is not None), None)
                        for name, value in r.items():
                            if value is None:
                                continue
                            to, rule = routes[name]
                            chain = [rule] if rule else []
                            cast = cast_value(value, main.get((section, to), _kind(value)))
                            if cast is None:
                                chain.append(f"uncast {_kind(value)}")
                            else:
                                value, steps = cast
                                chain += [f"cast {s}" for s in steps]
                            out.append((file_id, path, section, no, key, to, name, _text(value), _kind(value), ", ".join(chain) or "kept"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"record_no": "Int32"})

    return once.mapInPandas(rows, RECORD)


RECORD = "file_id string, path string, section string, record_no int, record_key string, field string, field_before string, value string, kind string, rule string"
_IS_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
