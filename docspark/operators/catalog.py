"""Object catalog: replicas, uploads, states, idempotency, versions and logs as relations.

The store itself (sockets, fsync, agents) is out of scope; these are its
queries over fact tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed moves of an upload.
TRANSITIONS = [("staging", "replicating_chunks"), ("replicating_chunks", "replicating_manifest"), ("replicating_manifest", "committed"), ("staging", "failed"), ("replicating_chunks", "failed"), ("replicating_manifest", "failed"), ("failed", "staging")]


def replica_domains(placements: DataFrame, keys: list[str], domain: str, confirmed: Column) -> DataFrame:
    """Distinct failure domains with a confirmed copy of each object; an object without any has 0."""
    return placements.groupBy(*keys).agg(F.countDistinct(F.when(confirmed, F.col(domain))).alias("domains"))


def below_floor(placements: DataFrame, keys: list[str], domain: str, confirmed: Column, floor: int) -> DataFrame:
    return replica_domains(placements, keys, domain, confirmed).where(F.col("domains") < floor)


def commit_gate(chunks: DataFrame, upload: str, floor: int, manifests: DataFrame | None = None) -> DataFrame:
    """Per upload: chunks, chunks at the floor, committable. chunks: (upload, hash or null, domains).

    Every chunk needs a hash and enough domains, and so does the manifest, if
    manifests (upload, domains) are given.
    """
    ok = F.col("hash").isNotNull() & (F.col("domains") >= floor)
    gate = chunks.groupBy(upload).agg(F.count("*").alias("chunks"), F.count(F.when(ok, 1)).alias("ready"))
    good = F.col("chunks") == F.col("ready")
    if manifests is None:
        return gate.withColumn("committable", good)
    m = manifests.select(upload, (F.col("domains") >= floor).alias("manifest_ok"))
    return gate.join(m, upload, "left").withColumn("committable", good & F.coalesce("manifest_ok", F.lit(False))).drop("manifest_ok")


def illegal_moves(history: DataFrame, key: str, order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Steps of a history that no legal transition allows: key, previous, state and how often."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = history.select(key, F.col(state).alias("state"), F.lag(state).over(w).alias("previous")).where("previous is not null")
    allowed = F.concat_ws(">", "previous", "state").isin([f"{a}>{b}" for a, b in legal])
    return steps.where(~allowed).groupBy(key, "previous", "state").agg(F.count("*").alias("n"))


def set_once_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were given more than one value, with the number of values."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def idempotent_requests(requests: DataFrame, key: str, fingerprint: str, result: str, order: str) -> DataFrame:
    """Per key: the first request's result, requests, and whether fingerprints disagree (a conflict)."""
    return requests.groupBy(key).agg(F.min_by(result, order).alias("result"), F.count("*").alias("requests"), (F.countDistinct(fingerprint) > 1).alias("conflict"))


def unique_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def agents_valid(agents: DataFrame, agent: str, domain: str) -> DataFrame:
    """One row: agents, distinct agents, distinct domains, and whether both are unique."""
    out = agents.agg(F.count("*").alias("agents"), F.countDistinct(agent).alias("n_agents"), F.countDistinct(domain).alias("n_domains"))
    return out.withColumn("valid", (F.col("agents") == F.col("n_agents")) & (F.col("agents") == F.col("n_domains")))


def contiguous(rows: DataFrame, key: str, ordinal: str, first: int = 0) -> DataFrame:
    """Per key: rows and whether its ordinals are first, first + 1, ... without gap or repeat: no sort is needed."""
    n = F.count("*")
    out = rows.groupBy(key).agg(n.alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    return out.select(key, "n", ((F.col("n") == F.col("d")) & (F.col("lo") == first) & (F.col("hi") == first + F.col("n") - 1)).alias("contiguous"))


def latest(rows: DataFrame, key: str, generation: list[Column]) -> DataFrame:
    """The row of the highest generation of each key."""
    w = Window.partitionBy(key).orderBy(*generation)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fold_log(log: DataFrame, key: str, seq: str, op_id: str, is_delete: Column, snapshot: DataFrame | None = None) -> DataFrame:
    """Current state of a log after a snapshot: an operation counts once, the last of a key wins, tombstones fall out.

    The last row is found by max_by, which combines before the exchange.
    """
    rows = log.withColumn("__deleted", is_delete)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.withColumn("__deleted", F.lit(False)), allowMissingColumns=True)
    last = rows.dropDuplicates([op_id]).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.col(seq), F.col(op_id))).alias("x"))
    return last.select(key, "x.*").where(~F.col("__deleted")).drop("__deleted")


def tombstone_ratio(log: DataFrame, partition: Column, is_delete: Column, threshold: float = 0.25) -> DataFrame:
    """Per partition: operations, share of tombstones, and whether to compact."""
    out = log.groupBy(partition.alias("part")).agg(F.count("*").alias("ops"), F.round(F.avg(is_delete.cast("double")), 6).alias("ratio"))
    return out.withColumn("compact", F.col("ratio") > threshold)


def hash_prefix(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key's hash (of at most 32): a range splits by taking one bit more."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.shiftright(h, 32 - depth)


def split_plan(rows: DataFrame, key: str, depth: int, most: int) -> DataFrame:
    """Partitions of the given depth with their sizes, and the sizes of both halves of those above `most`."""
    deep = rows.select(hash_prefix(F.col(key), depth + 1).alias("half")).groupBy("half").count()
    out = deep.groupBy(F.shiftright("half", 1).alias("part")).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("half") % 2 == 0, F.col("count")).otherwise(0)).alias("low"), F.sum(F.when(F.col("half") % 2 == 1, F.col("count")).otherwise(0)).alias("high"))
    return out.withColumn("split", F.col("n") > most)


def unreferenced(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Objects that no live manifest names."""
    return objects.join(references.select(key).distinct(), key, "left_anti")


def replicate_outcomes(objects: DataFrame, agents: DataFrame, ok: Column, object_key: str, domain: str, floor: int) -> DataFrame:
    """Every object tried on every agent (a configured handful): copies made, domains reached, floor met."""
    tries = objects.crossJoin(F.broadcast(agents)).withColumn("ok", ok)
    out = tries.groupBy(object_key).agg(F.count(F.when(F.col("ok"), 1)).alias("copies"), F.countDistinct(F.when(F.col("ok"), F.col(domain))).alias("domains"))
    return out.withColumn("met", F.col("domains") >= floor)


def blocks(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """Fixed-size blocks of a text or binary column with their hashes; an empty file has none."""
    n = F.ceil(F.length(content) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.select(key, F.col(content).alias("__c"), F.explode(at).alias("ordinal"))
    part = F.substring("__c", F.col("ordinal") * size + 1, F.lit(size))
    return rows.select(key, "ordinal", F.length(part).cast("long").alias("len"), F.sha2(part, 256).alias("hash"))


def request_fingerprint(*parts: Column) -> Column:
    """Hash of the parts, each preceded by its length, so no two lists of parts collide by concatenation."""
    return F.sha2(F.concat(*(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts)), 256)


def encrypt(content: Column, key: Column, iv: Column, aad: Column) -> Column:
    """AES-GCM with a 12-byte IV that the caller made once and stored before use."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def decrypt(content: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _key_aad(purpose: Column, owner: Column, generation: Column) -> Column:
    return F.concat_ws("|", purpose, owner, generation).cast("binary")


def wrap_key(key: Column, master: Column, iv: Column, purpose: Column, owner: Column, generation: Column) -> Column:
    """A content key encrypted by the master key, bound to what it is for, whose it is and its generation."""
    return encrypt(key, master, iv, _key_aad(purpose, owner, generation))


def unwrap_key(wrapped: Column, master: Column, purpose: Column, owner: Column, generation: Column) -> Column:
    """The content key; an error for another master key, purpose, owner or generation, or if it hasn't 32 bytes."""
    key = decrypt(wrapped, master, _key_aad(purpose, owner, generation))
    return F.when(F.length(key) == 32, key).otherwise(F.raise_error(F.lit("a wrapped key has another length")).cast("binary"))


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and of the new ones those whose key isn't there yet."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti"))


def confirm(placements: DataFrame, confirmations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state) of every placement, confirmed or pending, and of confirmations without one: orphan, which the caller must refuse."""
    p = placements.select(*keys, F.lit(True).alias("__placed")).distinct()
    c = confirmations.select(*keys, F.lit(True).alias("__confirmed")).distinct()
    state = F.when(F.col("__placed").isNull(), "orphan").when(F.col("__confirmed").isNull(), "pending").otherwise("confirmed")
    return p.join(c, keys, "full").select(*keys, state.alias("state"))


def compacted(log: DataFrame, key: str, seq: str, op_id: str, is_delete: Column, settled: Column) -> DataFrame:
    """The log's last operation of every key; tombstones that are `settled` (all replicas have seen them) go, too."""
    rows = log.withColumn("__gone", is_delete & settled)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.col(seq), F.col(op_id))).alias("x"))
    return last.select(key, "x.*").where(~F.col("__gone")).drop("__gone")


def first_valid_replica(replicas: DataFrame, object_key: str, agent: str, content: str) -> DataFrame:
    """Per object the content of the first agent whose bytes hash to the object's name; null if none does."""
    good = F.sha2(content, 256) == F.col(object_key)
    return replicas.groupBy(object_key).agg(F.min_by(F.when(good, F.col(content)), F.when(good, F.col(agent))).alias("content"), F.count(F.when(good, 1)).alias("valid"), F.count("*").alias("copies"))


def assemble(chunks: DataFrame, upload: str, ordinal: str, content: str) -> DataFrame:
    """A file's bytes (binary, whatever they are) from its chunks in order; a file is one row's worth of chunks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.hex(F.col(content).cast("binary")).alias("c"))))
    return chunks.groupBy(upload).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["c"]), "")).alias("content"))


def verify_agents(expected: DataFrame, reported: DataFrame, agent: str, identity: str) -> DataFrame:
    """Expected agents with their state: ok, silent, or another identity."""
    r = reported.select(agent, F.col(identity).alias("__got"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "silent").when(F.col(identity).eqNullSafe(F.col("__got")), "ok").otherwise("other identity")
    return expected.join(r, agent, "left").select(agent, state.alias("state"))


def pack_placements(sizes: list[tuple[str, int]], agents: list[tuple[str, int]]) -> dict[str, str]:
    """Greedy placement of partitions (largest first) on the agent with most room; raises if one doesn't fit."""
    room, out = dict(agents), {}
    for part, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        agent = max(sorted(room), key=lambda a: room[a])
        if room[agent] < size:
            raise ValueError(f"no agent has room for {part}")
        room[agent] -= size
        out[part] = agent
    return out
