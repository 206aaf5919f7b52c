"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model.

Each line is the first or a later line of a turn by the user, the assistant or
the system: six states. What a line shows is its speaker marker (of a known kind,
a name, or none), and features of its text. Viterbi's best path gives the roles;
turns are then rendered in one canonical form. All transcripts of a batch advance
in step, line by line. All tables, those of markers too, are counted over
transcripts whose roles are known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dittograph.llm import flat
from dittograph.storage import written

ROLES = ("user", "assistant", "system")
KNOWN = {
    "user": "user human q question customer client prompter me you visitor instruction input prompt",
    "assistant": "assistant ai bot a answer agent chatbot model gpt response output reply support helper",
    "system": "system sys context setup admin",
}
_KIND = {word: k + 1 for k, role in enumerate(ROLES) for word in KNOWN[role].split()}
_NAMES = 4  # kinds: 0 none, 1..3 the roles' words, 4.. the first, second and any later name
KINDS = _NAMES + 3
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[|>+\s*)?(?:im_start\|>)?([^\W\d_][\w ]{0,18}?)(?:\|?>|\]|\*\*)?\s*(?:\(\d[\d: ]*\))?\s*(:\*\*|:|\|>|>|\]|$)\s*")
_WRAPPED = re.compile(r"^\s*(?:<\|?|\[|#{1,4}\s)")
LENGTHS = 6
@dataclass
class Tables:
    """Probabilities: next role of a turn (row 3: of the first), going on with a turn, marker kinds and line features by state."""

    turn: np.ndarray = field(default_factory=lambda: np.array([[0.05, 0.94, 0.01], [0.94, 0.05, 0.01], [0.90, 0.08, 0.02], [0.75, 0.05, 0.20]]))
    more: np.ndarray = field(default_factory=lambda: np.array([0.3, 0.7, 0.3]))
    length: np.ndarray = field(default_factory=lambda: np.full((6, LENGTHS), 1 / LENGTHS))
    question: np.ndarray = field(default_factory=lambda: np.full((6, 2), 0.5))
    kind: np.ndarray = field(default_factory=lambda: _prior() / _prior().sum(1, keepdims=True))


def _prior() -> np.ndarray:
    """Counts of marker kinds by state before any transcript is seen: a first line has its role's word, a later one none."""
    out = np.full((6, KINDS), 0.05)
    out[:3, 0], out[3:, 0] = 1, 8
    out[np.arange(3), np.arange(3) + 1] = 4
    out[:3, _NAMES:] = 0.5
    return out


def marker(line: str) -> tuple[str, str]:
    """Speaker in lower case and the rest of the line; no speaker is ''."""
    m = _MARKER.match(line)
    if not m:
        return "", line
    name, closing = m[1].strip().lower(), m[2]
    if name in _KIND:
        return (name, line[m.end() :]) if closing or _WRAPPED.match(line) else ("", line)
    # a name: one or two capitalised words before a colon
    if closing in (":", ":**") and re.fullmatch(r"[^\W\d_]\w*( [^\W\d_]\w*)?", m[1]) and all(w[0].isupper() for w in m[1].split()):
        return name, line[m.end() :]
    return "", line


def features(text: str) -> tuple[list[int], list[int], list[int], list[str]]:
    """Marker kind, length class, whether it asks, and the text without marker, of each line."""
    kinds, lengths, asks, rests, names = [], [], [], [], {}
    for line in text.split("\n"):
        name, rest = marker(line)
        kinds.append(0 if not name else _KIND.get(name) or _NAMES + min(names.setdefault(name, len(names)), 2))
        lengths.append(min(LENGTHS - 1, len(rest.strip()).bit_length() // 2))
        asks.append(int(rest.rstrip().endswith("?")))
        rests.append(rest)
    return kinds, lengths, asks, rests


def logs(tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log tables: start of 6 states, 6 x 6 moves, emissions by kind (6 x KINDS) and by (length, asks)."""
    begin = np.full(6, -60.0)
    begin[:3] = np.log(tables.turn[3])
    move = np.full((6, 6), -60.0)
    for a in range(6):
        role = a % 3
        move[a, :3] = np.log(1 - tables.more[role]) + np.log(tables.turn[role])
        move[a, 3 + role] = np.log(tables.more[role])
    kind = np.log(tables.kind)
    look = np.log(tables.length)[:, :, None] + np.log(tables.question)[:, None, :]
    return begin, move, kind, look


def viterbi(kinds: np.ndarray, lengths: np.ndarray, asks: np.ndarray, at: np.ndarray, tables: Tables) -> np.ndarray:
    """Best state of every line; lines ``at[k]..at[k + 1]`` are those of transcript k. Of equal paths the lower state wins."""
    begin, move, kind, look = logs(tables)
    emit = kind[:, kinds].T + look[:, lengths, asks].T
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, size = at[:-1][order], size[order]
    state, back = np.zeros(len(kinds), np.int64), np.zeros((len(kinds), 6), np.int8)
    if not len(size) or not size[0]:
        return state
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    score = begin + emit[start[: alive[0]]]
    last = np.zeros((len(size), 6))
    last[: alive[0]] = score
    for t in range(1, size[0]):
        m = alive[t]
        paths = last[:m, :, None] + move
        back[start[:m] + t] = paths.argmax(1)
        last[:m] = paths.max(1) + emit[start[:m] + t]
    now = last.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        m = alive[t]
        state[start[:m] + t] = now[:m]
        now[:m] = np.take_along_axis(back[start[:m] + t], now[:m, None], 1)[:, 0]
    return state


def rendered(turns: list[tuple[str, str]]) -> str:
    """Canonical form of turns: a line with the role, the text, a closing line."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def parse(texts: list[str | None], tables: Tables) -> list[list[tuple[str, str]] | None]:
    """Turns (role, text) of each transcript; null for null, none for a blank one."""
    found = [features(t) if t and t.strip() else ([], [], [], []) for t in texts]
    at = np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int64)
    flat_ = [np.array([x for f in found for x in f[k]], np.int64) for k in range(3)]
    state, out = viterbi(*flat_, at, tables), []
    for k, (text, f) in enumerate(zip(texts, found)):
        turns: list[tuple[str, list[str]]] = []
        for s, rest in zip(state[at[k] : at[k + 1]].tolist(), f[3]):
            if s < 3 or not turns:
                turns.append((ROLES[s % 3], [rest]))
            else:
                turns[-1][1].append(rest)
        out.append(None if text is None else [(role, "\n".join(lines).strip()) for role, lines in turns])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each state goes with each marker kind, length and question, and how roles follow, in known transcripts."""
    seen: Counter[tuple[int, int, int, int, int]] = Counter()
    for batch in batches:
        for turns in batch.column("turns").to_pylist():
            states, was = [], 3
            for t in turns:
                role = (t["role"] or "").strip().lower()
                k = ROLES.index(role) if role in ROLES else None
                n = t["line"].count("\n")
                states += [k] + [None if k is None else 3 + k] * n
                if k is not None:
                    seen[_FOLLOWS, was, k, 0, 0] += 1
                    was = k
            kinds, lengths, asks, _ = features("\n".join(t["line"] for t in turns))
            for x in zip(states, kinds, lengths, asks):
                if x[0] is not None:
                    seen[(0, *x)] += 1
    columns = zip(*[(*k, n) for k, n in seen.items()]) if seen else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["what", "a", "b", "c", "d", "n"])


_FOLLOWS = 1


def tables_from(known: DataFrame) -> Tables:
    """Tables counted over :func:`known_transcripts`; every count starts from 1, those of marker kinds from ``_prior``.

    Lines of turns without a known role aren't counted. No transcripts leave the prior and uniform tables.
    """
    rows = known.select("turns").mapInArrow(_counts, "what long, a long, b long, c long, d long, n long")
    kind, length, question, move = _prior(), np.ones((6, LENGTHS)), np.ones((6, 2)), np.ones((4, 3))
    for r in rows.groupBy("what", "a", "b", "c", "d").agg(F.sum("n").alias("n")).collect():
        if r.what == _FOLLOWS:
            move[r.a, r.b] += r.n
        else:
            kind[r.a, r.b] += r.n
            length[r.a, r.c] += r.n
            question[r.a, r.d] += r.n
    many = length.sum(1) - LENGTHS
    more = (many[3:] + 1) / (many[:3] + many[3:] + 2)
    share = lambda x: x / x.sum(1, keepdims=True)
    return Tables(share(move), more, share(length), share(question), share(kind))


def formatted(transcripts: DataFrame, tables: Tables) -> DataFrame:
    """``(conv_id, n_turns, roles, chat)`` of raw transcripts (conv_id, text).

    A null text has nulls, a blank one no turns and an empty chat. A null id stays;
    repeated rows are parsed each; ties between paths go to the lower state. A
    transcript of any length is parsed whole. Other columns are not read; an
    empty table gives no rows. A map without any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, "text"):
                found = parse(part.column("text").to_pylist(), tables)
                columns = [
                    part.column("conv_id"),
                    pa.array([None if t is None else len(t) for t in found], pa.int32()),
                    pa.array([None if t is None else [r for r, _ in t] for t in found], pa.list_(pa.string())),
                    pa.array([None if t is None else rendered(t) for t in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "roles", "chat"])

    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, n_turns int, roles array<string>, chat string")


#: Speaker markers of the styles in which raw transcripts are written, by role.
STYLES = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "System: "), ("Q: ", "A: ", "Context: "), ("### Instruction:\n", "### Response:\n", "### System:\n"), ("[user] ", "[assistant] ", "[system] "), ("Alice: ", "Bob: ", "System: "), ("<|user|>\n", "<|assistant|>\n", "<|system|>\n"))


def known_transcripts(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: conversations as different tools would export them, turn by turn (role, line) with the role that is meant.

    The style goes by a hash of conv_id; about one turn in twelve, by a hash too, has no
    marker. Turns are in order of turn, then role and text; a null role has no marker, a null text is empty.
    Rows without conv_id are left out.
    """

    def styled(role: int) -> Column:
        style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
        return F.element_at(F.array(*[F.lit(s[role]) for s in STYLES]), (style + 1).cast("int"))

    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(12)) == 0
    role = F.lower(F.trim("role"))
    mark = F.when(bare, "").when(role == "user", styled(0)).when(role == "assistant", styled(1)).when(role == "system", styled(2)).otherwise("")
    line = F.concat(mark, F.coalesce(F.col("text").cast("string"), F.lit("")))
    one = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", "role", "text", line.alias("line")).alias("one"))
    kept = F.transform(F.sort_array(F.collect_list("one")), lambda x: F.struct(x["role"].alias("role"), x["line"].alias("line")))
    return one.groupBy("conv_id").agg(kept.alias("turns"))


def raw_transcripts(known: DataFrame) -> DataFrame:
    """``(conv_id, text)``: known transcripts as raw text."""
    return known.select("conv_id", F.array_join("turns.line", "\n").alias("text"))


def parsed_by_others(turns: DataFrame) -> DataFrame:
    """Every conversation of ``turns`` as raw text, :func:`formatted` with tables from the other half of the conversations.

    Halves go by a hash of conv_id, so no conversation is parsed by what was counted in it.
    """
    known = written(known_transcripts(turns), "transcripts")
    half = F.pmod(F.xxhash64("conv_id", F.lit(2)), F.lit(2))
    tables = [tables_from(known.filter(half == k)) for k in (0, 1)]
    out = [formatted(raw_transcripts(known.filter(half == k)), tables[1 - k]) for k in (0, 1)]
    return out[0].unionByName(out[1])
