"""Chat formatting with a prefix tree: conversations that share their first turns share their first tokens.

Turns are written in a template with control marks, control strings inside roles and texts escaped reversibly.
Conversations of a pack are merged into a tree of turns, which is written out once, depth first: every token has a
position id (its place in its own conversation), every node the intervals of its ancestors, which together with the
tokens before it in the node are all that a token may attend to, and a loss mask marks the assistants' texts. The child
with the most nodes below it is written first, next to its parent, and intervals that touch are one, so that a node of a
tree of n nodes has about log2(n) intervals at most, however deep it lies.

Equal conversations are one leaf. Conversations are sorted by the hashes of their turns, so that those which begin alike
are neighbours at every depth, and the sorted rows are cut into packs: one conversation and as much further text as a
pack holds, in which shared turns count once. A pack stays small whatever is shared, and shared turns are repeated only
where a cut, or the border between two tasks, runs through the conversations below them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PACK_CHARS = 1 << 20
#: Characters that the template adds to a turn.
TURN_CHARS = len(START) + len(END) + 2

_TURNS = "array<struct<role:string,text:string>>"
_PACKS = (
    "pack long, tokens array<int>, positions array<int>, loss array<boolean>,"
    " nodes array<struct<begin:int,end:int,parent:int>>, ancestors array<array<struct<begin:int,end:int>>>,"
    " leaves array<struct<key:string,node:int>>"
)


def escape(text: str) -> str:
    """Text in which no control string begins: a backslash more between < and |."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Coder:
    """Tokens of texts: a byte-level vocabulary file of the tokenizers library, or plain UTF-8 bytes; and two marks."""

    def __init__(self, path: str | None):
        self.model = None
        self.size = 256
        if path:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            self.size = self.model.get_vocab_size()
        self.start, self.end = self.size, self.size + 1

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.model is None:
            return [list(t.encode()) for t in texts]
        return [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of tokens, marks included."""
        out, run = [], []
        for token in [*ids, -1]:
            if 0 <= token < self.size:
                run.append(token)
                continue
            if run:
                out.append(bytes(run).decode() if self.model is None else self.model.decode(run, skip_special_tokens=False))
                run = []
            if token >= 0:
                out.append(START if token == self.start else END)
        return "".join(out)


_CODERS: dict[str | None, Coder] = {}


def coder(path: str | None) -> Coder:
    """The coder of a vocabulary file, read once per task."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


# --- packs --------------------------------------------------------------------------------------------------


def conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, key): the turns in order, and a key that equal conversations share.

    Rows of one turn number are ordered by role and text, a null number comes first, a null role or text is empty.
    Rows without a conversation id are one conversation.
    """
    part = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    gathered = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), part.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    turns = F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    found = gathered.select("conv_id", turns.alias("turns"))
    return found.withColumn("key", F.sha2(F.to_json("turns"), 256))


def pack(found: DataFrame, *, tokenizer: str | None = None, pack_chars: int = PACK_CHARS) -> DataFrame:
    """One row per pack: tokens, position ids, loss mask, nodes with their ancestors' intervals, and leaves by key.

    Token ids are those of the vocabulary file ``tokenizer`` (a path every executor can read; bytes if None), followed
    by two for the control marks. ``nodes`` are in the order of writing; ``parent`` is -1 for a first turn.
    ``ancestors`` of a node are its ancestors' intervals from the first turn on: the last is its parent's, those before it
    are merged where they touch. An empty table gives no packs.
    """
    distinct = found.groupBy("key").agg(F.first("turns").alias("turns"))
    steps = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    # keys are distinct, so no range of the sort can be hot
    dealt = distinct.withColumn("steps", steps).repartitionByRange("steps", "key").sortWithinPartitions("steps", "key")

    def cut(batches):
        for members in _cuts(batches, pack_chars):
            yield from _tree(members, tokenizer).to_batches()

    return dealt.select("key", "turns").mapInArrow(cut, _PACKS)


def _cuts(batches, pack_chars: int):
    """The members of each pack, as (key, turns), from sorted rows: the first, and others of ``pack_chars`` of new text."""
    members: list[tuple[str, list[tuple[str, str]]]] = []
    size = 0
    for batch in batches:
        keys, turns = batch.column("key"), batch.column("turns")
        for i in range(batch.num_rows):
            path = [(t["role"], t["text"]) for t in turns[i].as_py()]
            if members:
                before = members[-1][1]
                shared = next((j for j, (x, y) in enumerate(zip(before, path, strict=False)) if x != y), min(len(before), len(path)))
                size += sum(len(role) + len(text) + TURN_CHARS for role, text in path[shared:])
                if size > pack_chars:
                    yield members
                    members, size = [], 0
            members.append((keys[i].as_py(), path))
    if members:
        yield members


def _tree(members: list[tuple[str, list[tuple[str, str]]]], tokenizer: str | None) -> pa.Table:
    code = coder(tokenizer)
    children: list[dict[tuple[str, str], int]] = [{}]
    turns: list[tuple[str, str]] = [("", "")]
    leaves: list[tuple[str, int]] = []
    for key, path in members:
        node = 0
        for step in path:
            following = children[node].get(step)
            if following is None:
                following = children[node][step] = len(turns)
                turns.append(step)
                children.append({})
            node = following
        leaves.append((key, node))
    # a child is numbered after its parent
    below = [1] * len(turns)
    for node in range(len(turns) - 1, -1, -1):
        below[node] += sum(below[c] for c in children[node].values())
    order = [sorted(c.values(), key=lambda child: -below[child]) for c in children]
    heads = code.encode([escape_role(role) + "\n" for role, _ in turns[1:]])
    bodies = code.encode([escape(text) for _, text in turns[1:]])
    line = code.encode(["\n"])[0]

    tokens, positions, loss, nodes, ancestors, number = [], [], [], [], [], {}
    stack = [(c, -1, 0, []) for c in reversed(order[0])]
    while stack:
        node, parent, depth, above = stack.pop()
        body = bodies[node - 1]
        written = [code.start, *heads[node - 1], *body, code.end, *line]
        begin, masked = len(tokens), turns[node][0] == "assistant"
        tokens += written
        positions += range(depth, depth + len(written))
        head = 1 + len(heads[node - 1])
        loss += [masked and head <= i < head + len(body) for i in range(len(written))]
        number[node] = len(nodes)
        nodes.append({"begin": begin, "end": len(tokens), "parent": parent})
        ancestors.append(above)
        if len(above) > 1 and above[-2]["end"] == above[-1]["begin"]:
            above = [*above[:-2], {"begin": above[-2]["begin"], "end": above[-1]["end"]}]
        spans = [*above, {"begin": begin, "end": len(tokens)}]
        stack += [(c, number[node], depth + len(written), spans) for c in reversed(order[node])]
    row = {
        "pack": [int.from_bytes(bytes.fromhex(members[0][0][:16]), "big", signed=True)],
        "tokens": [tokens],
        "positions": [positions],
        "loss": [loss],
        "nodes": [nodes],
        "ancestors": [ancestors],
        "leaves": [[{"key": k, "node": number.get(n, -1)} for k, n in leaves]],
    }
    return pa.table(row, _PACK_SCHEMA)


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_PACK_SCHEMA = pa.schema(
    [
        ("pack", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.int32())),
        ("loss", pa.list_(pa.bool_())),
        ("nodes", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("parent", pa.int32())]))),
        ("ancestors", pa.list_(pa.list_(_SPAN))),
        ("leaves", pa.list_(pa.struct([("key", pa.string()), ("node", pa.int32())]))),
    ]
)


# --- reading back -------------------------------------------------------------------------------------------

_READ = f"key string, formatted string, turns {_TURNS}, loss_text string"


def read_back(packs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(key, formatted, turns, loss_text) of every leaf, from the packs alone.

    A leaf's tokens are those of its ancestors' intervals and its own; ``formatted`` is their text, ``turns`` what the
    template says, and ``loss_text`` the text under the loss mask with its escapes undone.
    """

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _read_pack(batch.slice(i, 1).to_pylist()[0], coder(tokenizer))

    return packs.mapInArrow(read, _READ)


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_READ_SCHEMA = pa.schema(
    [
        ("key", pa.string()),
        ("formatted", pa.string()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        ("loss_text", pa.string()),
    ]
)


def _runs(loss: np.ndarray, spans: list[tuple[int, int]]):
    """(begin, end) of each text under the mask: texts are apart, as marks lie between them."""
    for a, b in spans:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], loss[a:b], [False]]).astype(np.int8))) + a
        yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _read_pack(row: dict, code: Coder):
    tokens, loss = np.array(row["tokens"], np.int64), np.array(row["loss"], bool)
    out: list[dict] = []
    size = 0
    for leaf in row["leaves"]:
        spans = []
        if leaf["node"] >= 0:
            own = row["nodes"][leaf["node"]]
            spans = [(s["begin"], s["end"]) for s in (*row["ancestors"][leaf["node"]], own)]
        formatted = "".join(code.decode(tokens[a:b].tolist()) for a, b in spans)
        masked = "".join(unescape(code.decode(tokens[a:b].tolist())) for a, b in _runs(loss, spans))
        turns = [{"role": unescape_role(r), "text": unescape(t)} for r, t in _TURN.findall(formatted)]
        out.append({"key": leaf["key"], "formatted": formatted, "turns": turns, "loss_text": masked})
        size += len(formatted)
        if size > PACK_CHARS:
            yield pa.RecordBatch.from_pylist(out, _READ_SCHEMA)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _READ_SCHEMA)
