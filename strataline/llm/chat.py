"""Chat transcripts: a hidden Markov model recovers who speaks, and turns are rendered in one form.

A line's hidden state is a role and whether the line opens a turn or goes on with one. What is seen of a line is its
speaker marker (the role that the marker's word names, an unknown speaker, or none) and its shape (blank, a question,
short, long). Viterbi's algorithm finds the likeliest states of a whole transcript; an opening line starts a turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Words that name a role where they stand as a marker.
NAMES = {"system": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "model": 2, "gpt": 2}
_MARK = re.compile(r"^\s*(?:#{1,6}\s*|\*\*|<\|?|\[)?([A-Za-z]{1,14})(?:\*\*:|:\*\*|\|?>|\]:?|\s*:|(?<=#)\s*$)[ \t]?")
_HEADING = re.compile(r"^\s*#{1,6}\s*([A-Za-z]{1,14}):?\s*$")
#: Markers: none, one for each role, a name that isn't known. Shapes: blank, question, short, long.
NO_MARK, UNKNOWN = 0, 4
_OPEN, _ON = 0, 3  # states: _OPEN + role opens a turn, _ON + role goes on

START = np.array([0.3, 0.55, 0.14, 0.003, 0.004, 0.003])
#: From a role's line (opening or not) to: opening of system, user, assistant; going on.
NEXT_OPEN = np.array([[0.001, 0.25, 0.03], [0.005, 0.02, 0.28], [0.005, 0.25, 0.01]])
MARK = np.array(
    [[0.05, 0.93, 0.002, 0.002, 0.016], [0.15, 0.001, 0.82, 0.001, 0.028], [0.15, 0.001, 0.001, 0.82, 0.028]]
    + [[0.9945, 0.0003, 0.0003, 0.0003, 0.0046]] * 3
)
SHAPE = np.array([[0.02, 0.08, 0.5, 0.4], [0.01, 0.29, 0.5, 0.2], [0.01, 0.09, 0.3, 0.6], [0.2, 0.05, 0.35, 0.4], [0.2, 0.1, 0.4, 0.3], [0.2, 0.05, 0.25, 0.5]])


def _moves() -> np.ndarray:
    m = np.full((6, 6), 1e-9)
    for r in range(3):
        for s in (_OPEN + r, _ON + r):
            m[s, :3] = NEXT_OPEN[r]
            m[s, _ON + r] = 1 - NEXT_OPEN[r].sum()
    return np.log(m)


_LOG_START, _LOG_MOVE, _LOG_MARK, _LOG_SHAPE = np.log(START), _moves(), np.log(MARK), np.log(SHAPE)


def features(line: str) -> tuple[int, int, str]:
    """Marker, shape, and the line without a known marker."""
    m = _HEADING.match(line) or _MARK.match(line)
    body, mark = line, NO_MARK
    if m:
        role = NAMES.get(m.group(1).lower())
        mark = UNKNOWN if role is None else 1 + role
        body = line if role is None else line[m.end() :]
    shown = body.strip()
    shape = 0 if not shown and mark == NO_MARK else 1 if shown.endswith("?") else 2 if len(shown) < 120 else 3
    return mark, shape, body


def viterbi(marks: list[int], shapes: list[int]) -> list[int]:
    """The likeliest states; of equally likely ones, the first in order."""
    seen = _LOG_MARK[:, marks].T + _LOG_SHAPE[:, shapes].T
    best, back = _LOG_START + seen[0], []
    for row in seen[1:]:
        step = best[:, None] + _LOG_MOVE
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def turns(transcript: str) -> list[tuple[str, str]]:
    """(role, text) of each turn. A marker of a line inside a turn is text; blank edges of a turn go."""
    if not transcript.strip():
        return []
    seen = [(line, *features(line)) for line in transcript.split("\n")]
    out: list[tuple[str, list[str]]] = []
    for (line, _, _, body), state in zip(seen, viterbi([x[1] for x in seen], [x[2] for x in seen])):
        if state < _ON or not out:
            out.append((ROLES[state % 3], [body]))
        else:
            out[-1][1].append(line)
    return [(r, "\n".join(lines).strip()) for r, lines in out]


def render(found: list[tuple[str, str]]) -> str:
    """The canonical form: <|role|>, a line break, the text, <|end|>, a line break."""
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in found)


def format_chats(chats: DataFrame, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """id_col, turns (array<struct<role, text>>), rendered: for each row's whole transcript. Null or blank: no turns, ''."""

    def run(batches):
        for b in batches:
            found = [turns(t or "") for t in b["transcript"].to_pylist()]
            rows = [[{"role": r, "text": t} for r, t in x] for x in found]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(list(map(render, found)), pa.string())], names=["id", "turns", "rendered"])

    out = chats.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("transcript")).mapInArrow(run, "id long, turns array<struct<role:string,text:string>>, rendered string")
    return out.withColumnRenamed("id", id_col)


def _marker(role: Column, style: Column) -> Column:
    """Five ways in which transcripts mark who speaks; in the last, only a system's or first line is marked."""
    up = F.initcap(role)
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("System")
    return F.when(style == 0, F.concat(up, F.lit(": "))).when(style == 1, F.concat(human, F.lit(": "))).when(style == 2, F.concat(short, F.lit(": "))).when(style == 3, F.concat(F.lit("### "), up, F.lit("\n"))).otherwise(F.concat(F.lit("**"), up, F.lit(":** ")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, roles: plain transcripts of the turns, in a style that a hash of the id picks.

    A conversation's turns go by turn, then role and text; a null role is left unmarked and a null text is empty. One
    conversation's turns are laid together, as one text.
    """
    line = F.concat(F.coalesce(_marker(F.col("role"), F.pmod(F.xxhash64("conv_id"), F.lit(5))), F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", F.struct("turn", "role", line.alias("line")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.array_join("t.line", "\n").alias("transcript"), F.transform("t", lambda t: F.coalesce(t["role"], F.lit("?"))).alias("roles"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, roles (comma-joined), n_true (turns written), same_roles, rendered_sha256 of every conversation."""
    plain = transcripts(conversations)
    found = format_chats(plain).select("conv_id", F.transform("turns", lambda t: t["role"]).alias("got"), "rendered")
    out = plain.select(F.col("conv_id").cast("long").alias("c"), "roles").join(found, F.col("c").eqNullSafe(F.col("conv_id")))
    return out.select("conv_id", F.size("got").cast("long").alias("n_turns"), F.array_join("got", ",").alias("roles"), F.size("roles").cast("long").alias("n_true"), (F.col("got") == F.col("roles")).alias("same_roles"), F.sha2("rendered", 256).alias("rendered_sha256"))
