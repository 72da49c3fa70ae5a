"""Operator 10, secret scans with corpus-wide ownership frequency.

Base kinds, leftmost and not overlapping within a kind (matches that fail a length are dropped):
`assign` a keyword, a separator and a value of 12 characters or more; `access` AKIA keys of 18 or more;
`hex` runs of 16 or more.  Spans are whole matches in code points, end exclusive.

Method: each candidate's hash is counted by distinct repositories and owners over the whole corpus.
Candidates are the values of the base spans and further tokens (runs of [A-Za-z0-9+/_-] of `least`
or more with letters of both cases and digits).  A candidate that more than `owners` owners or
`repositories` repositories have is a widely copied example; the others are `live`.  Base spans always
stay; a further token becomes a span of kind `token` only if it is live and no base span covers it.
Repositories are (source, lang) and owners are sources by default.

Null text: no spans.  Null source or lang: an owner or repository of its own.  Null doc_id: kept.
Repeated rows: each returned (and counted once, as one owner).  Empty table: empty result.  Empty texts
have no spans; very long ones are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column_bytes, materialize, range_hashes, ready, steps

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run, since what fails the length is dropped
KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
KINDS = ("assign", "access", "hex", "token")
_HEX, _TOKEN, _UPPER, _DOWN, _DIGIT = (np.zeros(257, bool) for _ in range(5))
_HEX[list(b"0123456789abcdef")] = True
_UPPER[65:91] = _DOWN[97:123] = _DIGIT[48:58] = True
_TOKEN[:] = _UPPER | _DOWN | _DIGIT
_TOKEN[list(b"+/_-")] = True
SCAN = "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>, found array<struct<kind:string,first:int,last:int,hash:long>>"


def byte_runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of flagged bytes within texts, at least so long."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    f = np.zeros(len(flags) + 1, bool)
    f[:-1] = flags
    start = f.copy()
    start[1:] &= ~f[:-1] | edge[1:]
    starts = np.flatnonzero(start)
    stop = f[:-1] & (~f[1:] | edge[1:])
    ends = np.flatnonzero(stop) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index, end) by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, base, least: int) -> list[tuple[int, int]]:
    """Further tokens that no base span touches."""
    covered: list[list[int]] = []  # base spans by start, joined where they meet
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, k = [], 0
    for m in re.finditer(rf"[A-Za-z0-9+/_-]{{{least},}}", text):
        t, (a, b) = m[0], m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        free = k == len(covered) or covered[k][0] >= b
        if free and re.search("[A-Z]", t) and re.search("[a-z]", t) and re.search("[0-9]", t):
            out.append((a, b))
    return out


def value_hash(value: str) -> int:
    raw = np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)
    return int(range_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def scan(docs: DataFrame, least: int, owner: str, repository: tuple[str, ...], carry: bool = False) -> DataFrame:
    """SCAN rows: base results, and all candidates by kind, place and hash; with `carry` also `doc`, the
    input's row as a struct."""
    schema = StructType.fromDDL(SCAN)
    if carry:
        schema = schema.add("doc", docs.schema)
    columns = schema.names
    repo = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in repository])
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None) if carry else F.col("text")).cast("string").alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\x02")).alias("owner"), repo.alias("repository"),
        *([F.struct("*").alias("doc")] if carry else []),
    )
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            # a carried row holds its text already: it isn't sent twice
            body_, offsets_ = column_bytes(batch.column("doc").field("text").cast(pa.string()) if carry else batch.column("text"))
            for i, j in steps(offsets_):
                body, offsets = body_[offsets_[i] : offsets_[j]], offsets_[i : j + 1] - offsets_[i]
                raw = body.tobytes()
                suspects = {m.start() for m in KEYWORD.finditer(raw)} | {m.start() for m in re.finditer(b"AKIA", raw)}
                at = np.array(sorted(suspects), np.int64)
                for flags, size in ((_HEX, 16), (_TOKEN, least)):
                    at = np.concatenate((at, byte_runs(flags[body], offsets, size)[0]))
                hit = set((np.searchsorted(offsets, at, "right") - 1).tolist())
                rows = []
                for d in range(j - i):
                    if d not in hit:
                        rows.append((0, 0, 0, none, [], []))
                        continue
                    text = raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace")
                    base = base_spans(text)
                    found = []
                    for a, k, b in base:
                        value = ASSIGN.match(text, a)[2] if k == 0 else text[a:b]
                        found.append({"kind": KINDS[k], "first": a, "last": b, "hash": value_hash(value)})
                    found += [{"kind": "token", "first": a, "last": b, "hash": value_hash(text[a:b])} for a, b in token_spans(text, base, least)]
                    n = [sum(k == x for _, k, _ in base) for x in range(3)]
                    names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                    rows.append((*n, hashlib.sha256(",".join(names).encode()).hexdigest(), names, found))
                cols = list(zip(*rows, strict=True))
                kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("hash", pa.int64())]))
                own = [batch.column(c).slice(i, j - i) for c in ("row", "doc_id", "owner", "repository")]
                rest = [batch.column("doc").slice(i, j - i)] if carry else []
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], kind), *rest], names=columns)

    return slim.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_rows): counted in two steps, so a common hash is summed early."""
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_rows"))


def secrets(docs: DataFrame, least: int = 24, owners: int = 1, repositories: int = 2, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), carry: bool = False) -> DataFrame:
    """SCAN columns with `live`, an array of (first, kind, last) of the live candidates. Rows without any
    candidate need no join, and are not shuffled."""
    ready(docs.sparkSession)
    rows = materialize(scan(docs, least, owner, repository, carry), "secrets")
    some, none = rows.where(F.size("found") > 0), rows.where(F.size("found") == 0)
    found = rows.select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*")
    rare = ownership(found).where((F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories)).select("hash")
    live = found.join(rare, "hash", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "kind", "last"))).alias("live"))
    return some.join(live, "row", "left").unionByName(none, allowMissingColumns=True)


def with_spans(got: DataFrame) -> DataFrame:
    """Adds `kept`: (first, rank of kind, last, kind) of all spans in order: base ones and live tokens."""
    none = F.array().cast("array<struct<first:int,kind:string,last:int>>")
    live = F.coalesce("live", none)
    base = F.transform(F.filter("found", lambda c: c["kind"] != "token"), lambda c: F.struct(c["first"], c["kind"], c["last"]))
    both = F.concat(base, F.filter(live, lambda c: c["kind"] == "token"))
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    return got.withColumn("kept", F.sort_array(F.transform(both, lambda c: F.struct(c["first"].alias("first"), rank(c["kind"]).alias("rank"), c["last"].alias("last"), c["kind"].alias("kind")))))


def secrets_report(docs: DataFrame) -> DataFrame:
    got = with_spans(secrets(docs))
    text = F.array_join(F.transform("kept", lambda c: F.concat_ws(":", c["kind"], c["first"].cast("string"), c["last"].cast("string"))), ",")
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(F.coalesce("live", F.array().cast("array<struct<first:int,kind:string,last:int>>"))).cast("long").alias("n_live"))


def redact(docs: DataFrame, mark: str = "[secret]", **how) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows where there is one.

    Every row stays, repeated ones and those of null text or id included, with the input's columns whatever
    they are called: rows are carried as structs through the scan, which is written once."""
    got = with_spans(secrets(docs, carry=True, **how)).select("doc", "kept")
    text = F.col("doc.text").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, span):
        between = F.substring(text, state["at"] + 1, span["first"] - state["at"])
        on = F.struct(F.concat(state["out"], between, F.lit(mark)).alias("out"), span["last"].alias("at"))
        return F.when(span["first"] < state["at"], F.struct(state["out"].alias("out"), F.greatest(state["at"], span["last"]).alias("at"))).otherwise(on)

    new = F.when(F.size("kept") == 0, text).otherwise(F.aggregate("kept", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))
    columns = []
    for f in docs.schema:
        own = F.col("doc").getField(f.name)
        if f.name == "text":
            own = F.col("new").cast(f.dataType)
        elif f.name == "n_chars":
            own = F.when(F.size("kept") == 0, own).otherwise(F.length("new").cast(f.dataType))
        columns.append(own.alias(f.name))
    return got.withColumn("new", new).select(*columns)
