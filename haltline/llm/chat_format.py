"""Conversations as one marked text each, with the spans a model learns to write (operator 11).

Turns are sorted by key range, so a conversation of any length spreads over tasks; each task renders its turns
with a compiled template (`chat_template`). A turn only needs its number and whether it is the last, and only the
first conversation of a range may have begun in an earlier one: one row for each range carries that over.

Output: Parquet rows (conv_id, part, text, spans), one for each turn, the conversation being its parts in order.
`spans` are start and stop of learned text in code points of the part. Reading sorts parts by conversation again
and walks through them; only open digests are held, never a conversation.

Order and odd values: rows stand by turn (null first), then role, then a hash of the text; a null text or role is
empty; rows without conv_id form one conversation; repeated rows are repeated turns. An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.llm.blocks import text_blocks, whole_text
from haltline.llm.chat_template import Template, unguard
from haltline.session import cut_lineage

#: Strings that mean something in the formatted text and are guarded inside turns.
MARKS = ("### ", "</turn>")
TEMPLATE = """\
{%- for turn in messages -%}
### {{ turn.role | guarded(':') }}: {% if turn.role == 'assistant' -%}
{% generation %}{{ turn.text | guarded }}{% endgeneration %}
{%- else %}{{ turn.text | guarded }}{% endif %} </turn>
{% endfor %}
{%- if prompt_next %}### assistant: {% endif %}"""

_ROLE_END = re.compile(r"\\.|(: )", re.DOTALL)
_TURN_END = re.compile(r"\\.|( </turn>\n)", re.DOTALL)

PARTS = "conv_id long, part long, text string, spans array<struct<start:int,stop:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a text of `TEMPLATE`; a last open turn is only a prompt."""
    place = 0
    while text.startswith("### ", place):
        start = place + len("### ")
        role = next((one for one in _ROLE_END.finditer(text, start) if one[1]), None)
        words = role and next((one for one in _TURN_END.finditer(text, role.end()) if one[1]), None)
        if words is None:
            return
        yield unguard(text[start : role.start()]), unguard(text[role.end() : words.start()])
        place = words.end()


def write_chats(
    turns: DataFrame,
    path: str,
    template: str = TEMPLATE,
    prompt_next: bool = False,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> None:
    """Format turns(conv_id, turn, role, text) into the folder `path`.

    `prompt_next` ends each conversation with the start of an answer. Templates may use turn.role and turn.text.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        whole_text(F.col(role_col)).alias("role"),
        whole_text(F.col(text_col)).alias("text"),
    )
    # Ranges are found by a hash of the text, not by texts, where many turns share one number.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    ranged = cut_lineage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
        .withColumn("bucket", F.spark_partition_id())
    )
    carried = _carried(ranged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, MARKS, prompt_next=prompt_next)
        held, number, open_end = None, 0, False
        for block in text_blocks(batches):
            done = []
            for row in block.to_pylist():
                if held is None:
                    number, open_end = carried[row["bucket"]]
                else:
                    same = row["conv_id"] == held["conv_id"]
                    done.append(_part(compiled, held, number, not same))
                    number = number + 1 if same else 0
                held = row
            yield pa.RecordBatch.from_pylist(done, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([_part(compiled, held, number, not open_end)], schema)

    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(_SPAN))]
    )
    ranged.mapInArrow(run, PARTS).write.parquet(path)


def _part(template: Template, row: dict, number: int, last: bool) -> dict:
    out = template.turn({"role": row["role"], "text": row["text"]}, number, last)
    spans = [{"start": start, "stop": stop} for start, stop in out.spans]
    return {"conv_id": row["conv_id"], "part": number, "text": "".join(out.pieces), "spans": spans}


def _carried(ranged: DataFrame) -> dict[int, tuple[int, bool]]:
    """For each range: turns of its first conversation in earlier ranges, whether its last one goes on.

    One row comes to the driver for each range, of which there are as many as shuffle partitions.
    """
    # Nulls sort before every number here as they do in the ranges.
    key = F.struct(F.col("conv_id").isNotNull().alias("given"), "conv_id", "n")
    counts = ranged.groupBy("bucket", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("bucket").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    edges.sort(key=lambda row: row.bucket)
    carried: dict[int, tuple[int, bool]] = {}
    running = 0
    for place, row in enumerate(edges):
        before = edges[place - 1].high.conv_id if place else object()
        running = running if place and before == row.low.conv_id else 0
        behind = edges[place + 1].low.conv_id if place + 1 < len(edges) else object()
        carried[row.bucket] = (running, behind == row.high.conv_id)
        whole = row.low.conv_id == row.high.conv_id
        running = running + row.high.n if whole else row.high.n
    return carried


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path)


def chat_texts(parts: DataFrame) -> DataFrame:
    """(conv_id, text, spans) with each conversation in one row, for those that are to fit into one."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text", "spans")))
    none = F.struct(F.lit(0).alias("size"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    moved = lambda size: lambda span: F.struct(
        (span["start"] + size).alias("start"), (span["stop"] + size).alias("stop")
    )
    joined = F.aggregate(
        "parts",
        none,
        lambda all_, part: F.struct(
            (all_["size"] + F.length(part["text"])).alias("size"),
            F.concat(all_["spans"], F.transform(part["spans"], moved(all_["size"]))).alias("spans"),
        ),
    )
    return (
        parts.groupBy("conv_id")
        .agg(ordered.alias("parts"))
        .select(
            "conv_id",
            F.array_join(F.transform("parts", lambda part: part["text"]), "").alias("text"),
            joined["spans"].alias("spans"),
        )
    )


class _Digest:
    """What is known of the conversation being read."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: Iterable[dict]) -> None:
        self.chars += len(text)
        for role, words in read_turns(text):
            self.turns += 1
            self.all.update(f"{role}\n{words}\n".encode())
        for span in spans:
            words = unguard(text[span["start"] : span["stop"]])
            self.loss_chars += len(words)
            self.loss.update(words.encode())

    def row(self, conv_id: int | None) -> dict:
        digests = self.all.hexdigest(), self.loss.hexdigest()
        values = (conv_id, self.turns, digests[0], self.loss_chars, digests[1], self.chars)
        return dict(zip(_DIGESTS, values, strict=True))


_DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def chat_digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from parts of `TEMPLATE`.

    A digest over a whole conversation has to be taken in order: its parts stream through one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv_id, digest = False, None, _Digest()
        for block in text_blocks(batches):
            done = []
            for row in block.to_pylist():
                if started and row["conv_id"] != conv_id:
                    done.append(digest.row(conv_id))
                    digest = _Digest()
                started, conv_id = True, row["conv_id"]
                digest.add(row["text"], row["spans"])
            yield pa.RecordBatch.from_pylist(done, schema)
        if started:
            yield pa.RecordBatch.from_pylist([digest.row(conv_id)], schema)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    schema = pa.schema(list(zip(_DIGESTS, kinds, strict=True)))
    return (
        parts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(
            run,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long",
        )
    )
