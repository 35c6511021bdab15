"""Applying a feed of inserts, updates and deletes to rebuild current state.

The feed arrives late, repeatedly and out of order; ``tx`` numbers the events in
their true order. Work is split by a hash of the entity id. Inside a bucket an
embedded DuckDB table holds one row per entity with the sequences of its latest
insert, patch and delete; every write is an upsert whose conflict clause compares
the stored sequence with the incoming one, so replays and stale deliveries lose
whatever the order of arrival. Deletes leave tombstones (an entity may be deleted by
a change that arrives before its insert). Bucket results are exported by Spark's
committer into a staging folder that is renamed into place in one step.

Hot entities: before the shuffle every map task applies its own deliveries to an
embedded table of the same kind and sends on what that table holds, at most one row per
entity and effect (more only where the table is emptied to keep its size). A claim with
a third of all events reaches its bucket as a few rows per map task, where the same
upsert takes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import plan_bytes, shared_dir
from loomgraph.sources.publish import publish

INSERT, PATCH, SCORE, DELETE = "insert", "patch", "score", "delete"

#: Event types of the store that create, patch or retire an entity, with the
#: payload key that names it. Only the asserted types create.
EFFECTS = (
    ("claim.asserted", "claim_id", "claim", INSERT),
    ("edge.asserted", "edge_id", "edge", INSERT),
    ("claim.rank_changed", "claim_id", "claim", PATCH),
    ("claim.superseded", "old_claim_id", "claim", DELETE),
)

CHANGE_COLUMNS = ("entity_id", "effect", "seq", "entity_kind", "body", "moment")
CHANGE_SCHEMA = "entity_id string, effect string, seq bigint, entity_kind string, body string, moment bigint"


def normal_id(column: Column) -> Column:
    """Ids compare without regard to case and surrounding white space; blank is null."""
    bare = F.regexp_replace(F.lower(column), r"^[\s ]+|[\s ]+$", "")
    return F.when(bare != "", bare)


def event_effects(events: DataFrame, with_body: bool = False, with_scores: bool = False) -> DataFrame:
    """One row per effect of an event: ``entity_id, effect, seq, entity_kind, body, moment``.

    ``seq`` is twice the transaction number, plus one for the event's own effect, so
    a reference in ``supersedes`` acts before it. Events with a null ``tx`` have no
    place in the order and are ignored, as are unknown types and bodies that are not
    JSON objects. ``body`` is the payload of inserts and patches if asked for; a patch
    that carries a confidence (or rank) is also a score, as a later patch without one leaves
    it standing. ``moment`` is the event's ``ts`` in microseconds where there is one. Extra
    columns of ``events`` are ignored.
    """
    kind = normal_id(F.col("event_type"))
    body = F.from_json(F.col("payload"), "claim_id string, edge_id string, old_claim_id string, confidence string")
    own = F.lit(None)
    for event_type, key, entity, effect in reversed(EFFECTS):
        own = F.when(
            kind == event_type,
            F.struct(
                normal_id(F.col("_body")[key]).alias("entity_id"),
                F.lit(effect).alias("effect"),
                (F.col("tx") * 2 + 1).alias("seq"),
                F.lit(entity).alias("entity_kind"),
            ),
        ).otherwise(own)
    reference = F.struct(
        normal_id(F.col("supersedes")).alias("entity_id"),
        F.lit(DELETE).alias("effect"),
        (F.col("tx") * 2).alias("seq"),
        F.lit(None).cast("string").alias("entity_kind"),
    )
    effects = [own, reference]
    if with_body or with_scores:
        is_number = F.expr("try_cast(_body.confidence as double) is not null")
        effects.append(F.when((kind == "claim.rank_changed") & is_number, F.struct(
            normal_id(F.col("_body.claim_id")).alias("entity_id"), F.lit(SCORE).alias("effect"), (F.col("tx") * 2 + 1).alias("seq"), F.lit("claim").alias("entity_kind"))))
    wanted = kind.isin([e[0] for e in EFFECTS]) | normal_id(F.col("supersedes")).isNotNull()
    text = F.col("payload") if with_body else F.lit(None).cast("string")
    moment = F.unix_micros(F.col("ts").cast("timestamp")) if "ts" in events.columns and (with_body or with_scores) else F.lit(None).cast("bigint")
    said = F.when(F.col("e.effect") == SCORE, F.col("_body.confidence")).when(F.col("e.effect") != DELETE, F.col("_text"))
    return (
        events.where(F.col("tx").isNotNull() & wanted)
        .select("event_type", "tx", "supersedes", body.alias("_body"), text.alias("_text"), moment.alias("moment"))
        .select(F.explode(F.array(*effects)).alias("e"), "_text", "_body", "moment")
        .where(F.col("e.entity_id").isNotNull())
        .select("e.*", said.alias("body"), F.when(F.col("e.effect").isin(INSERT, DELETE), F.col("moment")).alias("moment"))
    )


STATE_SCHEMA = (
    "entity_id string, entity_kind string, insert_seq bigint, insert_body string, "
    "patch_seq bigint, patch_body string, delete_seq bigint, active boolean, "
    "score_body string, insert_at bigint, delete_at bigint"
)


_CHANGE_FIELDS = pa.schema([
    ("entity_id", pa.string()), ("effect", pa.string()), ("seq", pa.int64()), ("entity_kind", pa.string()), ("body", pa.string()), ("moment", pa.int64()),
])
_STATE_FIELDS = pa.schema([
    ("entity_id", pa.string()), ("entity_kind", pa.string()), ("insert_seq", pa.int64()), ("insert_body", pa.string()),
    ("patch_seq", pa.int64()), ("patch_body", pa.string()), ("delete_seq", pa.int64()), ("active", pa.bool_()),
    ("score_body", pa.string()), ("insert_at", pa.int64()), ("delete_at", pa.int64()),
])


class _Upserts:
    """One embedded table that takes changes in any order and any repetition.

    A statement cannot write a row twice. Of the deliveries at hand the first of every entity
    goes in one statement, the second in the next, and so on for ``LAYERS`` statements; what
    an entity has beyond that in one go (only a hot one has) is reduced to its latest first.
    """

    #: Deliveries at hand at a time, and statements that take them as they came.
    STATEMENT, LAYERS = 8192, 4
    #: Effect, the kind it names, and the columns for its sequence, kind, body and time. A tombstone
    #: of unnamed kind retires a claim or an edge, the other only a claim.
    TAKES = (
        (INSERT, "true", "insert_seq", "entity_kind", "insert_body", "insert_at"),
        (PATCH, "entity_kind = 'claim'", "claim_patch_seq", None, "patch_body", None),
        (SCORE, "entity_kind = 'claim'", "claim_score_seq", None, "score_body", None),
        (DELETE, "entity_kind is null", "delete_seq", None, None, "delete_at"),
        (DELETE, "entity_kind = 'claim'", "claim_delete_seq", None, None, "claim_delete_at"),
    )
    #: What has to be greater in a new delivery than in the stored row for it to be taken.
    NEWER = "({new}) > ({old})"

    def __init__(self):
        import duckdb

        # no folder to spill to: what a table holds is bounded by its bucket
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.db.execute(
            "create table state (entity_id varchar primary key, entity_kind varchar, "
            "insert_seq bigint default -1, insert_body varchar, insert_at bigint, "
            "claim_patch_seq bigint default -1, patch_body varchar, "
            "claim_score_seq bigint default -1, score_body varchar, "
            "delete_seq bigint default -1, delete_at bigint, claim_delete_seq bigint default -1, claim_delete_at bigint)"
        )
        self.bytes = 0

    def take(self, batch: pa.RecordBatch) -> None:
        for start in range(0, batch.num_rows, self.STATEMENT):
            part = batch.slice(start, self.STATEMENT)
            self.bytes += part.nbytes
            self.db.register("arrived", pa.Table.from_batches([part]))
            self.db.execute(
                "create or replace temp table feed as select * exclude (place), least(row_number() over "
                f"(partition by entity_id, effect, entity_kind order by place), {self.LAYERS + 1}) as turn "
                "from (select *, row_number() over () as place from arrived)"
            )
            self.db.unregister("arrived")
            waiting = self.db.execute("select distinct turn, effect, entity_kind is null from feed order by all").fetchall()
            for turn, effect, unnamed in waiting:
                for what, named, *columns in self.TAKES:
                    if what == effect and (named == "true" or ("null" in named) == unnamed):
                        self._upsert(turn, effect, named, *columns)

    def _upsert(self, turn: int, effect: str, named: str, seq: str, kind: str | None, body: str | None, moment: str | None) -> None:
        fields = {"entity_id": "entity_id", seq: "seq"} | {c: f for c, f in ((kind, "entity_kind"), (body, "body"), (moment, "moment")) if c}
        order = [seq] + [f"coalesce({{}}{c}, '')" for c in (kind, body) if c] + ([f"coalesce({{}}{moment}, 0)"] if moment else [])
        side = lambda t: ", ".join(o.format(t) if "{" in o else t + o for o in order)
        latest = "qualify row_number() over (partition by entity_id order by seq desc, coalesce(entity_kind, '') desc, coalesce(body, '') desc, coalesce(moment, 0) desc) = 1"
        self.db.execute(
            f"insert into state ({', '.join(fields)}) select {', '.join(fields.values())} from feed "
            f"where turn = {turn} and effect = '{effect}' and {named} {latest if turn > self.LAYERS or named == 'true' else ''} "
            f"on conflict (entity_id) do update set {', '.join(f'{c} = excluded.{c}' for c in fields if c != 'entity_id')} "
            f"where {self.NEWER.format(new=side('excluded.'), old=side('state.'))}"
        )

    def changes(self) -> pa.Table:
        """What the table holds as changes again, for a table further on."""
        held = [
            f"select entity_id, '{effect}' as effect, {seq} as seq, "
            f"{kind or ('null::varchar' if 'null' in named else chr(39) + 'claim' + chr(39))} as entity_kind, {body or 'null::varchar'} as body, "
            f"{moment or 'null::bigint'} as moment from state where {seq} >= 0"
            for effect, named, seq, kind, body, moment in self.TAKES
        ]
        return self.db.sql(" union all ".join(held)).to_arrow_table().cast(_CHANGE_FIELDS)

    def states(self) -> pa.Table:
        # a patch or delete counts for a claim only if the entity is one; older ones are void
        return self.db.sql(
            "select entity_id, entity_kind, insert_seq, insert_body, "
            "case when entity_kind = 'claim' and claim_patch_seq > insert_seq then claim_patch_seq end as patch_seq, "
            "case when entity_kind = 'claim' and claim_patch_seq > insert_seq then patch_body end as patch_body, "
            "nullif(greatest(delete_seq, case when entity_kind = 'edge' then -1 else claim_delete_seq end), -1) as delete_seq, "
            "insert_seq >= 0 and insert_seq > delete_seq "
            "and (entity_kind <> 'claim' or insert_seq > claim_delete_seq) as active, "
            "case when entity_kind = 'claim' and claim_score_seq > insert_seq then score_body end as score_body, insert_at, "
            "case when entity_kind is distinct from 'edge' and claim_delete_seq > delete_seq then claim_delete_at else delete_at end as delete_at "
            "from state"
        ).to_arrow_table().cast(_STATE_FIELDS)

    def empty(self) -> None:
        self.db.execute("delete from state")
        self.bytes = 0


#: Bytes of the feed per core below which its rows are spread over the cores first.
SPREAD = 4 << 20
#: Bytes of deliveries after which a map task sends on what its table holds.
FLUSH = 64 << 20


def _apply_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map task's deliveries, reduced by the upsert to the latest per entity and effect."""
    table = _Upserts()
    for batch in batches:
        table.take(batch)
        if table.bytes > FLUSH:
            yield from table.changes().to_batches()
            table.empty()
    yield from table.changes().to_batches()


def _apply_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's states: between what the map tasks send on, the conflict clause decides."""
    table = _Upserts()
    for batch in batches:
        table.take(batch)
    yield from table.states().to_batches()


def _buckets(changes: DataFrame) -> int:
    """One bucket per 16 MB of the feed as stored; of a feed of unknown size one per input partition."""
    partitions = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(changes)
    return max(partitions, -(-size // (16 << 20)) if size else changes.rdd.getNumPartitions())


def apply_changes(changes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Current state of every entity, tombstones included (lazy; nothing is published).

    ``changes`` has the columns of :func:`event_effects`. Repeated rows, equal
    sequences and any arrival order give the same result; of two inserts with equal
    sequence the larger kind, then the larger body wins. An empty feed gives an empty state. Entities that
    were only deleted appear with a null ``entity_kind``, ``insert_seq`` -1 and
    ``active`` false. ``buckets`` defaults to one per 16 MB of the feed, at least the session's
    shuffle partitions.
    """
    return _in_buckets(changes, buckets).mapInArrow(_apply_bucket, STATE_SCHEMA)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The feed reduced to its latest change per entity and effect, in the same columns."""
    return _in_buckets(changes, None).mapInArrow(_apply_locally, CHANGE_SCHEMA)


def _in_buckets(changes: DataFrame, buckets: int | None) -> DataFrame:
    changes = changes.select(*CHANGE_COLUMNS)
    cores, size = changes.sparkSession.sparkContext.defaultParallelism, plan_bytes(changes)
    if 0 < size < cores * SPREAD:
        changes = changes.repartition(cores)  # a small feed lies in one or two files
    return changes.mapInArrow(_apply_locally, CHANGE_SCHEMA).repartition(buckets or _buckets(changes), "entity_id")


def rebuild_state(events: DataFrame, with_body: bool = True, path: str | None = None) -> DataFrame:
    """Fold the whole log and publish the state atomically; returns a scan of it.

    ``path`` names the table folder; by default a new one below the shared folder. Readers
    see the old state or the new one, never a mixture (see ``sources.publish``).
    """
    spark: SparkSession = events.sparkSession
    state = apply_changes(event_effects(events, with_body=with_body))
    return publish(state, path or f"{shared_dir(spark)}/claim-state-{uuid.uuid4().hex}")


def active_entities(state: DataFrame) -> DataFrame:
    """``entity_id, assert_tx, patch_tx`` of what is active; 0 where nothing patched it."""
    return state.where("active").select(
        "entity_id",
        F.expr("(insert_seq - 1) div 2").alias("assert_tx"),
        F.expr("coalesce((patch_seq - 1) div 2, 0)").alias("patch_tx"),
    )
