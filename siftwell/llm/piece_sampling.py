"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary.

The lattice of a text has an edge for every piece that spells a stretch of it. Forward filtering sums, at each position, the weight of all
paths that lead there; backward sampling then walks from the end and picks each edge with its share of that sum, which draws whole segmentations
exactly by their weight. Random numbers come from a counter hash of the row key and the place in the text, so a row gets the same pieces
wherever and whenever it is computed. Decoding joins the pieces and is lossless.

Between two characters that stand side by side in no piece every path has a cut, so the text falls into independent units (about a word each).
Equal units of a block share one lattice; only the walks are drawn for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581  # stands for a space
LITERAL = 0x110000  # stands for the character U+2581 itself; past Unicode, so in no piece, and spelled by its bytes
BLOCK_CHARS = 1 << 16  # characters worked on at a time
SLICE_ROWS = 64  # rows held as Python text at a time
ALPHA = 1.0  # inverse temperature: larger values favour frequent and long pieces
SALT = 0x9E3779B97F4A7C15
_U = np.uint64


class Vocabulary(NamedTuple):
    pieces: list[str]
    table_keys: np.ndarray  # open addressing over hashes of all prefixes of pieces
    table_ids: np.ndarray  # piece id, -1 for a mere prefix
    logs: np.ndarray  # log weight by piece id
    pairs: np.ndarray  # sorted codes of character pairs inside pieces
    bytes_at: np.ndarray  # ids of the 256 byte pieces
    single: dict[str, int]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64), element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mix(h * _U(0x100000001B3) + c + _U(1))


def _extend_one(h: int, c: int) -> int:
    """_extend of one hash."""
    x = (h * 0x100000001B3 + c + 1) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    """Read once for each Python worker. A unigram vocabulary brings log weights. The scores of a BPE vocabulary are its merge order, no weights; there a piece's
    weight falls with its rank, 1 / (rank + 2), as frequencies by rank do."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    rank = {i: r for r, i in enumerate(plain)}
    logs = np.full(len(pieces), -np.log(len(plain) + 2.0))
    merge_order = all(float(model.get_score(i)).is_integer() for i in plain)
    for i, r in rank.items():
        logs[i] = -np.log(r + 2.0) if merge_order else model.get_score(i)
    logs -= np.log(np.exp(logs).sum())
    bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    prefixes: dict[int, int] = {}
    pairs: set[int] = set()
    for i in plain:
        key, codes = 0, [ord(c) for c in pieces[i]]
        for n, c in enumerate(codes, 1):
            key = _extend_one(key, c)
            if n == len(codes):
                prefixes[key] = i
            else:
                prefixes.setdefault(key, -1)
                pairs.add(c << 21 | codes[n])
    size = 1 << (4 * len(prefixes)).bit_length()
    keys, ids = np.zeros(size, _U), np.full(size, -2, np.int64)
    for key, i in prefixes.items():
        at = key & (size - 1)
        while ids[at] != -2:
            at = (at + 1) & (size - 1)
        keys[at], ids[at] = key, i
    return Vocabulary(pieces, keys, ids, logs, np.array(sorted(pairs), np.int64), bytes_at, {pieces[i]: i for i in plain if len(pieces[i]) == 1})


def _lookup(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Piece id of each hash, -1 for a prefix that is no piece, -2 for neither."""
    mask = len(v.table_keys) - 1
    at = (h & _U(mask)).astype(np.int64)
    out = v.table_ids[at]
    open_ = np.flatnonzero((v.table_keys[at] != h) & (out != -2))
    while len(open_):
        at[open_] = (at[open_] + 1) & mask
        out[open_] = v.table_ids[at[open_]]
        open_ = open_[(v.table_keys[at[open_]] != h[open_]) & (out[open_] != -2)]
    return out


class Lattice(NamedTuple):
    begin: np.ndarray  # first position of each unit; unit u has the positions begin[u] .. begin[u] + length[u]
    length: np.ndarray
    into: np.ndarray  # first edge that ends at a position, edges being sorted by their end
    source: np.ndarray  # position at which an edge begins
    piece: np.ndarray  # piece id; -1 for the bytes of a character that no piece spells
    share: np.ndarray  # weight of all paths that end in an edge, as a share of those that end at its position, summed up to the edge


def lattice(v: Vocabulary, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, alpha: float) -> Lattice:
    """Edges and forward sums of units given as stretches of codes. Positions are numbered unit by unit, each with one more than its characters."""
    base = np.concatenate([[0], np.cumsum(length + 1)])
    unit_of = np.repeat(np.arange(len(length)), length)
    offset = np.arange(len(unit_of)) - np.repeat(np.cumsum(length) - length, length)
    char_at = begin[unit_of] + offset
    node = base[unit_of] + offset
    left = length[unit_of] - offset
    sources, ends, ids = [], [], []
    h = np.zeros(len(node), _U)
    active = np.arange(len(node))
    spelled = np.zeros(len(node), bool)
    n = 0
    with np.errstate(over="ignore"):
        while len(active):
            h = _extend(h, codes[char_at[active] + n])
            n += 1
            found = _lookup(v, h)
            hit = found >= 0
            if n == 1:
                spelled[active[hit]] = True
            sources.append(node[active[hit]])
            ends.append(node[active[hit]] + n)
            ids.append(found[hit])
            on = (found != -2) & (left[active] > n)
            active, h = active[on], h[on]
    rest = np.flatnonzero(~spelled)
    sources.append(node[rest])
    ends.append(node[rest] + 1)
    ids.append(np.full(len(rest), -1, np.int64))
    source, end, piece = np.concatenate(sources), np.concatenate(ends), np.concatenate(ids)
    order = np.argsort(end, kind="stable")
    source, end, piece = source[order], end[order], piece[order]
    into = np.searchsorted(end, np.arange(base[-1] + 1))
    # A character without a piece costs its bytes; it is the only edge over that character, so any constant keeps the distribution.
    weight = alpha * np.where(piece >= 0, v.logs[piece], -10.0)
    total = np.full(base[-1], -np.inf)
    total[base[:-1]] = 0.0
    part = np.empty(len(end))
    # All units advance together, one character at a time. Shorter units drop out.
    by_length = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[by_length], -np.arange(1, (length.max() if len(length) else 0) + 1), side="right")
    for d, count in enumerate(alive.tolist(), 1):
        here = base[by_length[:count]] + d
        lo, hi = into[here], into[here + 1]
        width = hi - lo
        edges = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        value = total[source[edges]] + weight[edges]
        starts = np.concatenate([[0], np.cumsum(width)[:-1]])
        top = np.maximum.reduceat(value, starts)
        scaled = np.exp(value - np.repeat(top, width))
        sums = np.add.reduceat(scaled, starts)
        total[here] = top + np.log(sums)
        part[edges] = scaled / np.repeat(sums, width)
    running = np.cumsum(part)
    lead = np.concatenate([[0.0], running])[into[:-1]]
    share = running - np.repeat(lead, np.diff(into))
    return Lattice(base[:-1], length, into, source, piece, share)


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the row key and the place in the text alone."""
    with np.errstate(over="ignore"):
        return (_mix(key + (place.astype(_U) + _U(1)) * _U(SALT)) >> _U(11)).astype(np.float64) / float(1 << 53)


def walk(lat: Lattice, kind: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward sampling of one path for each occurrence. kind: its unit in the lattice; key, place: of the row and of its first character.
    Gives (occurrence, offset, piece) of the edges, unsorted."""
    who = np.arange(len(kind))
    begin = lat.begin[kind]
    at = begin + lat.length[kind]
    out_who, out_at, out_piece = [], [], []
    while len(who):
        lo, hi = lat.into[at], lat.into[at + 1]
        edge = lo.copy()
        wide = np.flatnonzero(hi - lo > 1)
        if len(wide):
            u = uniform(key[who[wide]], place[who[wide]] + (at[wide] - begin[wide]))
            e, last = lo[wide].copy(), hi[wide] - 1
            while True:
                on = (e < last) & (lat.share[e] <= u)
                if not on.any():
                    break
                e[on] += 1
            edge[wide] = e
        at = lat.source[edge]
        out_who.append(who)
        out_at.append(at - begin)
        out_piece.append(lat.piece[edge])
        on = at > begin
        who, at, begin = who[on], at[on], begin[on]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_who]), np.concatenate([none, *out_at]), np.concatenate([none, *out_piece])


def _escaped(text: str) -> np.ndarray:
    """Code points with the leading space that the model adds; spaces as its space mark, a space mark of the text itself as LITERAL."""
    codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    return np.where(codes == 32, _U(SPACE), np.where(codes == SPACE, _U(LITERAL), codes))


def encode(texts: list[str | None], keys: list[int], path: str = MODEL, alpha: float = ALPHA) -> list[np.ndarray | None]:
    """Piece ids of each text, sampled under its key. An empty text has no pieces; null stays null."""
    v = vocabulary(path)
    out: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int32) for t in texts]
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop] or "") <= BLOCK_CHARS):
            held += len(texts[stop] or "")
            stop += 1
        rows = [k for k in range(at, stop) if texts[k]]
        at = stop
        if not rows:
            continue
        parts = [_escaped(texts[k] or "") for k in rows]
        codes = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        found: list[list[np.ndarray]] = [[] for _ in rows]
        for row, (first, size) in enumerate(zip(firsts, sizes, strict=True)) if len(rows) == 1 else [(None, (0, len(codes)))]:
            for begins, lengths in _units(v, codes, firsts, int(first), int(first + size)):
                owner = np.searchsorted(firsts, begins, side="right") - 1
                ids, where = _sample(v, codes, begins, lengths, np.array([keys[k] for k in rows], np.int64).view(_U)[owner], begins - firsts[owner], alpha)
                splits = np.searchsorted(where, firsts[1:]) if row is None else np.zeros(0, np.int64)
                for k, part in enumerate(np.split(ids, splits)):
                    found[k].append(part)
        for k, parts_ in zip(rows, found, strict=True):
            out[k] = np.concatenate(parts_).astype(np.int32)
    return out


def _units(v: Vocabulary, codes: np.ndarray, firsts: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of codes[lo:hi], cut between texts as well, in blocks."""
    part = codes[lo:hi]
    pair = (part[:-1] << _U(21) | part[1:]).astype(np.int64)
    place = np.searchsorted(v.pairs, pair).clip(max=len(v.pairs) - 1)
    split = v.pairs[place] != pair
    inner = firsts[(firsts > lo) & (firsts < hi)] - lo
    split[inner - 1] = True
    cut = np.flatnonzero(split) + 1
    begins = np.concatenate([[0], cut]) + lo
    ends = np.concatenate([cut, [hi - lo]]) + lo
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + BLOCK_CHARS, side="right")))
        yield begins[at:stop], (ends - begins)[at:stop]
        at = stop


def _sample(v: Vocabulary, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, key: np.ndarray, place: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids in text order and the character at which each begins."""
    with np.errstate(over="ignore"):
        powers = np.cumsum(_mix(codes[begins[0] : begins[-1] + lengths[-1]] * _U(SALT) + _U(7)) * _position_keys(begins, lengths))
        upto = np.concatenate([np.zeros(1, _U), powers])
        print_ = _mix(upto[begins + lengths - begins[0]] - upto[begins - begins[0]] + lengths.astype(_U))
    _, first, kind = np.unique(print_, return_index=True, return_inverse=True)
    lat = lattice(v, codes, begins[first], lengths[first], alpha)
    who, offset, piece = walk(lat, kind, key, place)
    at = begins[who] + offset
    order = np.argsort(at, kind="stable")
    at, piece = at[order], piece[order]
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece, at
    spelled = [v.bytes_at[np.frombuffer(_spelling(int(c)), np.uint8)] for c in codes[at[odd]]]
    times = np.ones(len(piece), np.int64)
    times[odd] = [len(s) for s in spelled]
    ids, where = np.repeat(piece, times), np.repeat(at, times)
    ids[ids < 0] = np.concatenate(spelled)
    return ids, where


def _spelling(code: int) -> bytes:
    """The bytes of a character without a piece; a byte that is no UTF-8 stands as a lone surrogate for itself."""
    return chr(SPACE if code == LITERAL else code).encode("utf-8", "surrogateescape" if 0xDC80 <= code <= 0xDCFF else "surrogatepass")


def _position_keys(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An odd multiplier for each character's offset in its unit, so that a unit's print depends on order."""
    offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return _mix((offset.astype(_U) + _U(1)) * _U(0xD1342543DE82EF95)) | _U(1)


def decode_bytes(ids: np.ndarray | list[int] | None, path: str = MODEL) -> bytes | None:
    """The bytes of piece ids: pieces and bytes joined, space marks as spaces, the added leading space taken off."""
    if ids is None:
        return None
    spelled, _ = _spellings(path)
    return b"".join(map(spelled.__getitem__, np.asarray(ids, np.int64).tolist()))[1:]


def decode(ids: np.ndarray | list[int] | None, path: str = MODEL) -> str | None:
    """The text of piece ids. Bytes that are no UTF-8 become lone surrogates, as in encode."""
    found = decode_bytes(ids, path)
    return None if found is None else found.decode("utf-8", "surrogateescape")


@cache
def _spellings(path: str) -> tuple[list[bytes], None]:
    v = vocabulary(path)
    of_byte = {int(i): b for b, i in enumerate(v.bytes_at)}
    return [bytes([of_byte[i]]) if i in of_byte else p.replace("▁", " ").encode() for i, p in enumerate(v.pieces)], None


def row_key(key: Column, seed: int = 0) -> Column:
    """The 64-bit key of a row's random numbers; a null id counts as a key of its own."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(seed))


def sampled_ids(text: Column, key: Column, path: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> Column:
    """array<int> of the sampled piece ids."""
    return round_trip(text, key, path, alpha, seed)["ids"]


def round_trip(text: Column, key: Column, path: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> Column:
    """struct<ids array<int>, lossless boolean>: the sampled piece ids and whether decoding them gives the text back, in one pass over the text."""
    kind = pa.list_(pa.int32())

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def compute(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ids, same = [], []
        for at in range(0, len(texts), SLICE_ROWS):
            part = texts.slice(at, SLICE_ROWS).to_pylist()
            found = encode([None if b is None else b.decode("utf-8", "surrogateescape") for b in part], keys.slice(at, SLICE_ROWS).to_pylist(), path, alpha)
            ids.append(pa.array(found, kind))
            same += [decode_bytes(f, path) == t for f, t in zip(found, part, strict=True)]
        return pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], kind), *ids]), pa.array(same, pa.bool_())], ["ids", "lossless"])

    return compute(text.cast("binary"), row_key(key, seed))


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of piece ids."""

    @F.arrow_udf("binary")
    def compute(rows: pa.Array) -> pa.Array:
        return pa.array([decode_bytes(r.values.to_numpy() if r.is_valid else None, path) for r in rows], pa.binary())

    return compute(ids).cast("string")


def tokenize(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, ids, n_tokens, lossless (decoding the ids gives the text back).

    The text may hold anything: a space mark U+2581 of its own and bytes that are no UTF-8 are spelled by their bytes. Null texts have null ids; empty texts none. Rows
    that repeat an id and a text get the same pieces, with a null id too. Very long texts are worked on in blocks, whole. Other columns are not looked at, whatever
    their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), round_trip(F.col(text), F.col(key), path, alpha, seed).alias("told"))
    return rows.select("doc_id", "told.ids", F.coalesce(F.size("told.ids"), F.lit(0)).alias("n_tokens"), "told.lossless")
