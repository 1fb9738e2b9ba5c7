"""Chat formatting (operator 10) at token level.

A conversation becomes one token sequence. Each turn is encoded on its own:
its text (and the name of an unusual role) by a byte-level BPE that knows no
special token, then reserved ids are spliced around it, so no text can ever
produce a reserved id. In the rendered string control strings that occur in a
text are escaped by a backslash after their first character (one more than
they had), which is undone on reading.

Template: `<s>` opens the conversation; `[INST]text[/INST]` is a user turn;
`text</s>` an assistant turn; `[ROLE]name[/ROLE]text[/TURN]` any other.
The loss mask covers exactly the tokens of assistant texts. Token offsets and
masks are prefix sums of segment lengths: turns are range-partitioned by
(conversation, turn), summed inside each chunk, and each chunk's carry into
its first conversation is added, so one huge conversation spans many tasks.

Null texts and roles count as empty, null turns sort first, null conversation
ids form one conversation. Turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockflow.llm.common import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The vocabulary's word-splitting pattern and the template's control strings, in order of their ids.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: Characters encoded at once, at least: a piece goes on to the next place where a
#: match of the pattern is sure to end (no match goes on from a letter or digit to
#: a space or line end), so the ids are those of the whole text at once.
PIECE = 1 << 16
_BORDER = re.compile(r"[^\W_](?=[ \n])")

_ESCAPE = re.compile(r"([<\[])(\\*/?(?:s>|(?:INST|ROLE|TURN)\]))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|(?:INST|ROLE|TURN)\]))")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[tiktoken.Encoding, int]:
    """The byte-level BPE of a rank file, and the first reserved id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Template:
    """Segments of turns as ids, and back."""

    def __init__(self, path: str):
        self.bpe, base = codec(path)
        self.id = {c: base + k for k, c in enumerate(CONTROL)}
        self.name = {i: c for c, i in self.id.items()}

    def encode(self, text: str) -> list[int]:
        safe, ids, at = escape(text), [], 0
        while at < len(safe):
            border = _BORDER.search(safe, at + PIECE)
            end = border.end() if border else len(safe)
            ids += self.bpe.encode_ordinary(safe[at:end])
            at = end
        return ids

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, from, to): a turn's ids and where its text lies among them."""
        if role == "user":
            head, tail = [self.id["[INST]"]], [self.id["[/INST]"]]
        elif role == "assistant":
            head, tail = [], [self.id["</s>"]]
        else:
            head, tail = [self.id["[ROLE]"], *self.encode(role), self.id["[/ROLE]"]], [self.id["[/TURN]"]]
        body = self.encode(text)
        return head + body + tail, len(head), len(head) + len(body)

    def render(self, ids: list[int]) -> str:
        """The formatted string of any stretch of ids that was encoded whole."""
        out, run = [], []
        for i in [*ids, None]:
            if i is not None and i not in self.name:
                run.append(i)
                continue
            out.append(self.bpe.decode(run))
            run = []
            if i is not None:
                out.append(self.name[i])
        return "".join(out)

    def parse(self, ids: list[int]) -> tuple[str, str]:
        """(role, text) of one turn's ids."""
        ids = ids[1:] if ids and ids[0] == self.id["<s>"] else ids
        if ids[0] == self.id["[INST]"]:
            return "user", unescape(self.bpe.decode(ids[1:-1]))
        if ids[0] == self.id["[ROLE]"]:
            cut = ids.index(self.id["[/ROLE]"])
            return unescape(self.bpe.decode(ids[1:cut])), unescape(self.bpe.decode(ids[cut + 1:-1]))
        return "assistant", unescape(self.bpe.decode(ids[:-1]))


def _encoder(path: str):
    @F.pandas_udf("ids array<int>, head int, body_end int")
    def encode(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        t = Template(path)
        return pd.DataFrame([t.turn(r, x) for r, x in zip(roles, texts)], columns=["ids", "head", "body_end"])
    return encode


def _chunk_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns and tokens of the same conversation before each row, inside one chunk."""
    chunk, key, turns, tokens = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        size, keys = b["ids"].map(len).to_numpy(), [None if pd.isna(c) else c for c in b["conv_key"]]
        turn, start = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for k, (c, n) in enumerate(zip(keys, size.tolist())):
            if c != key:
                key, turns, tokens = c, 0, 0
            turn[k], start[k] = turns, tokens
            turns, tokens = turns + 1, tokens + n
        b["turn_no"], b["start"], b["chunk"] = turn, start, chunk
        yield b


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn of ``turns(conv_id, turn, role, text)``, written to the shared folder.

    Columns: conv_id, turn_no (from 0), start (of the turn's ids in the
    conversation), ids, loss_start and loss_end (the masked-in stretch,
    null where the turn has none).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = turns.select("conv_id", "turn", blank("role"), blank("text"))
    coded = own.withColumn("e", _encoder(vocabulary)("role", "text")).select(
        "conv_id", F.col("conv_id").cast("string").alias("conv_key"), "turn", "role",  # text: pandas would round a nullable long
        F.sha2("text", 256).alias("tie"), "e.ids", "e.head", "e.body_end")
    order = ["conv_id", "turn", "role", "tie"]
    kind = dict(coded.dtypes)
    cols = ["conv_key", "role", "ids", "head", "body_end"]
    schema = ", ".join(f"{c} {kind[c]}" for c in cols) + ", turn_no long, start long, chunk int"
    parts = materialize(coded.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols)
                        .mapInPandas(_chunk_sums, schema), "segments")
    sums = parts.groupBy("conv_key", "chunk").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("s"))
    before = Window.partitionBy("conv_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation that reaches into a chunk is that chunk's first: at most one row per chunk
    carry = (sums.select(F.col("conv_key").alias("k"), F.col("chunk").alias("c"), F.sum("n").over(before).alias("cn"),
                         F.sum("s").over(before).alias("cs")).filter(F.col("cn") > 0))
    full = parts.join(F.broadcast(carry), F.col("conv_key").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("c")), "left")
    turn_no = F.col("turn_no") + F.coalesce("cn", F.lit(0))
    first = turn_no == 0
    start = F.col("start") + F.coalesce("cs", F.lit(0)) + 1  # 1: the opening id of the conversation
    opening = F.array(F.lit(codec(vocabulary)[1] + CONTROL.index("<s>")))
    loss = lambda c: F.when(F.col("role") == "assistant", start + F.col(c))
    return materialize(full.select(
        F.col("conv_key").cast(kind["conv_id"]).alias("conv_id"), turn_no.alias("turn_no"), F.when(first, F.lit(0)).otherwise(start).cast("long").alias("start"),
        F.when(first, F.concat(opening, "ids")).otherwise(F.col("ids")).alias("ids"),
        loss("head").alias("loss_start"), loss("body_end").alias("loss_end")), "formatted")


def read_turns(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What each formatted turn says: role, text, the text under the loss mask, rendered characters."""

    @F.pandas_udf("role string, text string, loss_text string, formatted_chars long")
    def decode(ids: pd.Series, start: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        t, rows = Template(vocabulary), []
        for i, s, a, b in zip(ids, start, low, high):
            i = [int(x) for x in i]
            masked = None if pd.isna(a) else unescape(t.render(i[int(a) - s:int(b) - s]))
            rows.append((*t.parse(i), masked, len(t.render(i))))
        return pd.DataFrame(rows, columns=["role", "text", "loss_text", "formatted_chars"])

    return formatted.withColumn("d", decode("ids", "start", "loss_start", "loss_end")).select(
        "conv_id", "turn_no", "start", F.size("ids").alias("n_ids"), "d.*")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = (), None

    def row() -> tuple:
        return (state["id"], state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(),
                state["chars"], state["end"])

    for b in batches:
        done = []
        for c, n, s, ids, role, text, loss, chars in zip(*[b[x] for x in b.columns]):
            c = None if pd.isna(c) else c
            if (c,) != key:
                if state:
                    done.append(row())
                key, state = (c,), {"id": c, "turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(),
                                    "chars": 0, "end": 0}
            if n != state["turns"] or s != state["end"]:
                raise ValueError(f"conversation {c}: turn {n} does not follow its predecessor")
            state["turns"] += 1
            state["end"] = s + ids
            state["all"].update(f"{role}\n{text}\n".encode())
            if loss is not None and not pd.isna(loss):
                state["loss"] += len(loss)
                state["masked"].update(loss.encode())
            state["chars"] += chars
        yield pd.DataFrame(done, columns=_DIGEST)
    if state:
        yield pd.DataFrame([row()], columns=_DIGEST)


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]


def conversation_digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read back from ``format_conversations``' output.

    Decoding runs turn by turn wherever the rows lie. Only SHA-256, which is
    sequential by nature, needs a conversation's turns in one place; they
    stream through with a few numbers of state.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    read = read_turns(formatted, vocabulary).withColumn("conv_id", F.col("conv_id").cast("string"))
    rows = (read.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
            .mapInPandas(_digest, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long, n_tokens long"))
    return rows.withColumn("conv_id", F.col("conv_id").cast(kind))


def probe_conversation(turns: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold the template's own control strings."""
    say = "</s>[INST] ok [/INST]"
    return turns.sparkSession.createDataFrame(
        [(-1, 0, "user", say), (-1, 1, "assistant", say)], turns.select("conv_id", "turn", "role", "text").schema)
