"""Language of texts by a linear-chain conditional random field over words.

Each word is a position, each language a state.  A word's features are its
character n-grams of 1 to 4 characters including its boundaries (so prefixes and
suffixes are features of their own) and the whole word (a lexicon), hashed into
tables.  Transition weights between languages are learned with them, so text that
switches language is followed word by word.  A document's label comes from the
forward-backward posteriors: their mean over its words, the largest share being
the score.

A text is one chain.  To be worked on side by side it is cut every ``CHAIN`` words;
the messages of forward-backward are carried over the cuts, so results are those of
the uncut chain.  Training uses a bounded sample: about ``SAMPLE_ROWS`` documents of
each language, whole, outside the held-out fold; a language's sample ends with the
text that brings it to ``SAMPLE_BYTES``, if that comes first.  Some stretches of the
training chains are replaced by stretches of other languages.

Defined results: null text and text without a letter are ``und`` with score 0;
rows with a null language are not learned from; with nothing to learn from, every
text is ``und``; repeated rows get equal results; columns other than the key and
the text are dropped by ``predict`` and kept by ``keep_languages``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, byte_slices, is_held_out
from .words import Numbered, ascii_words

BITS = 16
GRAMS = (1, 2, 3, 4)
CHAIN = 64
SAMPLE_ROWS = 250
SAMPLE_BYTES = SAMPLE_ROWS * 8000
ROUNDS = 40
UNKNOWN = "und"
#: Text bytes labelled at once: features take some hundred bytes for each.
SLICE = 2 << 20


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first slot of each word): hashed n-grams with boundaries, and the whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "\x00" + "\x00".join(words) + "\x00"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = c == 0
    owner = np.cumsum(edge) - 1  # the boundary before a word belongs to it
    slots, owners = [], []
    for n in GRAMS:
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, np.int64)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                inner += edge[j : j + m]
        # Never across a boundary; a boundary alone or at the end of another word says nothing.
        ok = (inner == 0) & ~(edge[:m] & edge[n - 1 : n - 1 + m]) if n > 1 else ~edge
        slots.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[:m][ok])
    # The whole word: sum of characters times powers of a base, by place.
    place = np.arange(len(c)) - np.flatnonzero(edge)[owner]
    powers = np.cumprod(np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
    start = np.flatnonzero(edge)[:-1]
    whole = np.add.reduceat(c * powers[place], start)
    whole ^= whole >> np.uint64(31)
    slots.append((whole * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64))
    owners.append(np.arange(len(words)))
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.searchsorted(owners[order], np.arange(len(words)))


def sliced_features(words: list[str], step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``word_features``, made over ``step`` words at a time: what it needs meanwhile is many times its result."""
    parts = [word_features(words[i : i + step]) for i in range(0, len(words), step)] or [word_features([])]
    before = np.cumsum([0, *(len(slots) for slots, _ in parts)])
    return np.concatenate([slots.astype(np.int32) for slots, _ in parts]), np.concatenate([first + at for (_, first), at in zip(parts, before, strict=False)])


@dataclass
class Chains:
    """Words of a batch cut into chains; lanes of equal length, padded with code -1."""

    codes: np.ndarray  # (step, chain): number of the distinct word
    text: np.ndarray  # text of each chain
    follows: np.ndarray  # whether it goes on where the chain before it ends
    has_letter: np.ndarray  # of each distinct word
    words: list[str]


def cut_chains(n: Numbered, chain: int = CHAIN) -> Chains:
    lengths = np.diff(n.offsets)
    count = -(-lengths // chain)
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    index = np.arange(first[-1]) - np.repeat(first[:-1], count)
    start = np.repeat(n.offsets[:-1], count) + index * chain
    size = np.minimum(np.repeat(n.offsets[1:], count) - start, chain)
    at = start[None, :] + np.arange(chain)[:, None]
    valid = np.arange(chain)[:, None] < size[None, :]
    codes = np.where(valid, n.codes[np.minimum(at, max(len(n.codes) - 1, 0))] if len(n.codes) else -1, -1)
    letters = pc.match_substring_regex(pa.array(n.words, pa.string()), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    return Chains(codes, text, index > 0, letters, n.words)


def lowered(texts: pa.Array) -> Numbered:
    return ascii_words(pc.utf8_lower(texts))


class ChainField:
    """The conditional random field: feature weights, transitions, start weights."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.moves = np.zeros((k, k), np.float64)
        self.start = np.zeros(k, np.float64)

    def emissions(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32)
        # Language by language: the weights of all slots at once would take several times the memory.
        return np.stack([np.add.reduceat(self.weights[:, j][slots], first) for j in range(len(self.languages))], 1)

    def _carried(self, potentials: np.ndarray, valid: np.ndarray, follows: np.ndarray, move: np.ndarray, start: np.ndarray):
        """What comes into each lane from the lanes of its text before and after it.

        A lane is a matrix from the state before its first word to that of its last; the
        messages are passed from lane to lane by these.
        """
        steps, lanes, k = potentials.shape
        through = np.where(follows[:, None, None], move, start) * potentials[0][:, None, :]
        for t in range(1, steps):
            on = (through.reshape(-1, k) @ move).reshape(lanes, k, k) * potentials[t][:, None, :]
            through = np.where(valid[t][:, None, None], on, through)
            through /= through.sum((1, 2), keepdims=True)
        place = np.arange(lanes) - np.flatnonzero(~follows)[np.cumsum(~follows) - 1]
        order = np.argsort(place, kind="stable")
        turns = np.split(order, np.searchsorted(place[order], np.arange(1, place.max() + 1)))[1:]
        before, after = np.full((lanes, k), 1 / k, np.float32), np.ones((lanes, k), np.float32)
        for own in turns:
            x = np.einsum("li,lij->lj", before[own - 1], through[own - 1])
            before[own] = x / x.sum(1, keepdims=True)
        for own in reversed(turns):
            x = np.einsum("lij,lj->li", through[own], after[own])
            after[own - 1] = x / x.sum(1, keepdims=True)
        return before, after

    def posteriors(self, potentials: np.ndarray, valid: np.ndarray, follows: np.ndarray | None = None, moves: bool = True):
        """Forward-backward over lanes: (step, lane, language) posteriors and expected moves.

        ``potentials`` are exponentiated emissions, 1 where ``valid`` is false.  A lane
        that ``follows`` goes on where the lane before it ends.
        """
        steps, lanes, k = potentials.shape
        move = np.exp(self.moves).astype(np.float32)
        stay = np.eye(k, dtype=np.float32)
        first, backward = np.exp(self.start).astype(np.float32), np.ones((lanes, k), np.float32)
        linked = follows is not None and follows.any()
        if linked:
            before, backward = self._carried(potentials, valid, follows, move, first)
            first = np.where(follows[:, None], before @ move, first)
        forward = np.empty((steps, lanes, k), np.float32)
        a = potentials[0] * first
        forward[0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            a = np.where(valid[t][:, None], forward[t - 1] @ move, forward[t - 1]) * potentials[t]
            forward[t] = a / a.sum(1, keepdims=True)
        expected = np.zeros((k, k))
        out = np.empty_like(forward)
        p = forward[-1] * backward
        out[-1] = p / p.sum(1, keepdims=True)

        def expect(source: np.ndarray, b: np.ndarray):
            joint = source[:, :, None] * move[None] * b[:, None, :]
            return (joint / joint.sum((1, 2), keepdims=True)).sum(0)

        for t in range(steps - 1, 0, -1):
            b = potentials[t] * backward
            on = valid[t]
            if moves and on.any():
                expected += expect(forward[t - 1][on], b[on])
            backward = np.where(on[:, None], b @ move.T, b @ stay)
            backward /= backward.sum(1, keepdims=True)
            p = forward[t - 1] * backward
            out[t - 1] = p / p.sum(1, keepdims=True)
        if moves and linked:
            expected += expect(before[follows], (potentials[0] * backward)[follows])
        return out, expected

    def _potentials(self, chains: Chains, emissions: np.ndarray):
        valid = chains.codes >= 0
        e = emissions[np.maximum(chains.codes, 0)]
        e = np.where((valid & chains.has_letter[np.maximum(chains.codes, 0)])[:, :, None], e, 0)
        return np.exp(np.clip(e - e.max(2, keepdims=True), -30, 0)), valid

    def fit(self, chains: Chains, labels: np.ndarray, rounds: int = ROUNDS, rate: float = 0.15, decay: float = 1e-4) -> ChainField:
        """Maximise the likelihood of ``labels`` (step, chain), by Adam over the whole sample."""
        slots, first = sliced_features(chains.words)
        lengths = np.diff(np.append(first, len(slots)))
        k = len(self.languages)
        valid = chains.codes >= 0
        lettered = valid & chains.has_letter[np.maximum(chains.codes, 0)]
        one = np.eye(k, dtype=np.float32)
        pair = (labels[:-1] * k + labels[1:])[valid[1:]]
        over = np.flatnonzero(chains.follows)
        pair = np.append(pair, labels[valid.sum(0)[over - 1] - 1, over - 1] * k + labels[0, over])
        observed = np.bincount(pair, minlength=k * k).reshape(k, k)
        params = [self.weights, self.moves, self.start]
        m, v = ([np.zeros_like(p, np.float64) for p in params] for _ in range(2))
        total = max(int(valid.sum()), 1)
        for step in range(1, rounds + 1):
            potentials, _ = self._potentials(chains, self.emissions(slots, first))
            post, expected = self.posteriors(potentials, valid, chains.follows)
            off = (one[labels] - post)[lettered]
            per_word = np.stack([np.bincount(chains.codes[lettered], weights=off[:, j], minlength=len(chains.words)) for j in range(k)], 1)
            grads = [
                np.stack([np.bincount(slots, weights=np.repeat(per_word[:, j], lengths), minlength=1 << BITS) for j in range(k)], 1) / total - decay * self.weights / (1 << BITS),
                (observed - expected) / total,
                (one[labels[0]] - post[0])[~chains.follows].sum(0) / total,
            ]
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.2 * (g - a)
                b += 0.02 * (g * g - b)
                p += (rate * a / (1 - 0.8**step) / (np.sqrt(b / (1 - 0.98**step)) + 1e-7)).astype(p.dtype)
        return self

    def label_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, score) of each text."""
        count, k = len(texts), len(self.languages)
        chains = cut_chains(lowered(texts))
        if not chains.codes.shape[1] or not k:
            return np.full(count, -1), np.zeros(count)
        emissions = self.emissions(*sliced_features(chains.words))
        total, words = np.zeros((count, k)), np.zeros(count)
        # Parts of about 4096 chains, which end where a text does.
        ends = np.append(np.flatnonzero(~chains.follows), len(chains.text))
        ends = np.unique([0, *ends[np.searchsorted(ends, np.arange(4096, len(chains.text), 4096))], len(chains.text)])
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part = Chains(chains.codes[:, i:j], chains.text[i:j], chains.follows[i:j], chains.has_letter, chains.words)
            potentials, valid = self._potentials(part, emissions)
            post, _ = self.posteriors(potentials, valid, part.follows, False)
            lettered = valid & chains.has_letter[np.maximum(part.codes, 0)]
            sums = np.where(lettered[:, :, None], post, 0).sum(0)
            for j in range(k):
                total[:, j] += np.bincount(part.text, weights=sums[:, j], minlength=count)
            words += np.bincount(part.text, weights=lettered.sum(0), minlength=count)
        some = words > 0
        best = np.where(some, total.argmax(1), -1)
        return best, np.where(some, total.max(1) / np.maximum(words, 1), 0.0).clip(0, 1)

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its most likely language."""
        chains = cut_chains(lowered(pa.array([text])))
        if not chains.codes.shape[1]:
            return []
        potentials, valid = self._potentials(chains, self.emissions(*sliced_features(chains.words)))
        post, _ = self.posteriors(potentials, valid, chains.follows, False)
        return [(chains.words[chains.codes[t, c]], self.languages[int(post[t, c].argmax())]) for c in range(chains.codes.shape[1]) for t in range(chains.codes.shape[0]) if valid[t, c]]


def fit(texts: list[str], langs: list[str], seed: int = 4) -> ChainField:
    languages = sorted(set(langs))
    field = ChainField(languages)
    if not languages:
        return field
    of = np.array([languages.index(x) for x in langs])
    chains = cut_chains(lowered(pa.array(texts, pa.string())))
    labels = np.broadcast_to(of[chains.text], chains.codes.shape).copy()
    # A third of the chains get a second half from a chain of the sample at random.
    r = np.random.default_rng(seed)
    n = chains.codes.shape[1]
    mixed = r.permutation(n)[: n // 3]
    half, other = CHAIN // 2, r.permutation(n)[: n // 3]
    codes = chains.codes.copy()
    whole = (chains.codes[half - 1, mixed] >= 0) if n else np.zeros(0, bool)
    codes[half:, mixed[whole]] = chains.codes[:half, other[whole]]
    labels[half:, mixed[whole]] = of[chains.text[other[whole]]]
    return field.fit(Chains(codes, chains.text, chains.follows, chains.has_letter, chains.words), labels)


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, modulus: int = 4, remainder: int = 2) -> ChainField:
    found = bounded_texts(docs.where(~is_held_out(key, modulus, remainder)), key, text, lang, rows, sample_bytes)
    return fit(found["t"].tolist(), found["y"].tolist())


def predict(docs: DataFrame, model: ChainField, key: str = "doc_id", text: str = "text", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for whole in batches:
            for batch in byte_slices(whole, "t", SLICE):
                best, score = shared.value.label_batch(batch.column("t"))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), is_held_out(key, modulus, remainder).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"{key} {key_type}, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: ChainField, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """``docs`` without those that have no language: no letters, or no language that stands out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, text, SLICE):
                best, score = shared.value.label_batch(pc.fill_null(batch.column(text), ""))
                yield batch.filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
