"""All segmentations of a word into pieces of a fixed vocabulary.

A word's lattice has an edge for each piece of the vocabulary that occurs in
the word, with a mark of the word's start before its first letter.  The forward
recursion sums over all paths; with the backward one it gives the expected uses
of each piece.  Pieces do not reach over the end of a word, so the likelihood
of a text is the product over its words, and a word is worked out once however
often it occurs.  Short words are summed as products of doubles, which cannot
underflow there, and their sum is then a logarithm; longer ones are summed in
log space throughout.
"""

from __future__ import annotations

from math import exp, inf, log, log1p

import numpy as np

MARK = "▁"
#: Up to this length (with the mark) a product of piece weights stays a normal double.
SHORT = 24


def add_logs(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


class Weights:
    """Log weights of pieces as the recursions read them.

    After the pieces come four numbers for a character outside the vocabulary
    of one to four UTF-8 bytes: the unknown piece (number 0) and its bytes, each
    of 256 alike.
    """

    def __init__(self, logp: np.ndarray):
        full = np.concatenate([logp, logp[0] - np.log(256.0) * np.arange(1, 5)])
        self.log, self.linear = full.tolist(), np.exp(full).tolist()


class Lattice:
    """A vocabulary of pieces; number 0 is the unknown piece."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.prior = np.asarray(weights, dtype=np.float64) / np.sum(weights)
        # a node holds the next nodes by letter and the number of the piece that ends there, 0 for none
        self.root: tuple[dict, int] = ({}, 0)
        self.single = {piece for piece in pieces[1:] if len(piece) == 1}
        whole: dict = {}
        for i, piece in enumerate(pieces[1:], 1):
            node = whole
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = i
        self.root = _packed(whole)

    @classmethod
    def of_model(cls, path: str, lower: bool = False) -> Lattice:
        """Pieces of a public piece model, weighted by its scores.

        The scores of a merge vocabulary are ranks; rank r weighs 1 / (r + 10),
        as frequencies fall with rank.  Control and byte pieces are left out,
        with ``lower`` also those with letters A-Z, which lower-cased text lacks.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, weights = ["<unk>"], [1e-3]
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)):
                piece, score = model.id_to_piece(i), model.get_score(i)
                if MARK not in piece[1:] and not (lower and any("A" <= c <= "Z" for c in piece)):
                    pieces.append(piece)
                    weights.append(1.0 / (10.0 - max(score, -1e6)))
        return cls(pieces, np.array(weights))

    def __len__(self) -> int:
        return len(self.prior)

    def _unknown(self, letter: str) -> int:
        return len(self) - 1 + min(4, len(letter.encode("utf-8", "surrogatepass")))

    def edges(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """The places of a word and its edges (start, end, piece), by start."""
        text, root, out = MARK + word, self.root[0], []
        for s, letter in enumerate(text):
            kids, e = root, s
            for following in text[s:]:
                hit = kids.get(following)
                if hit is None:
                    break
                kids, piece = hit
                e += 1
                if piece:
                    out.append((s, e, piece))
            if letter not in self.single:  # a character outside the vocabulary
                out.append((s, s + 1, self._unknown(letter)))
        return len(text), out

    def _score_short(self, text: str, weight: list[float]) -> float:
        root, single, sums = self.root[0], self.single, [1.0] + [0.0] * len(text)
        for s, letter in enumerate(text):
            kids, e, here = root, s, sums[s]
            for following in text[s:]:
                hit = kids.get(following)
                if hit is None:
                    break
                kids, piece = hit
                e += 1
                if piece:
                    sums[e] += here * weight[piece]
            if letter not in single:
                sums[s + 1] += here * weight[self._unknown(letter)]
        return log(sums[-1])

    def score(self, word: str, models: list[Weights]) -> list[float]:
        """Natural log likelihood of the word under each model."""
        if len(models) == 1 and len(word) < SHORT:
            return [self._score_short(MARK + word, models[0].linear)]
        n, edges = self.edges(word)
        out = []
        for model in models:
            if n <= SHORT:
                sums, weight = [1.0] + [0.0] * n, model.linear
                for s, e, k in edges:
                    sums[e] += sums[s] * weight[k]
                out.append(log(sums[n]))
            else:
                logs, weight = [0.0] + [-inf] * n, model.log
                for s, e, k in edges:
                    logs[e] = add_logs(logs[e], logs[s] + weight[k])
                out.append(logs[n])
        return out

    def expect(self, word: str, count: float, model: Weights, uses: list[float]) -> None:
        """Adds the expected uses of each piece in ``count`` occurrences of the word."""
        n, edges = self.edges(word)
        last = len(self) - 1
        if n <= SHORT:
            ahead, behind, weight = [1.0] + [0.0] * n, [0.0] * n + [1.0], model.linear
            for s, e, k in edges:
                ahead[e] += ahead[s] * weight[k]
            part = count / ahead[n]
            for s, e, k in reversed(edges):
                way = weight[k] * behind[e]
                behind[s] += way
                uses[k if k <= last else 0] += ahead[s] * way * part
        else:
            ahead, behind, weight = [0.0] + [-inf] * n, [-inf] * n + [0.0], model.log
            for s, e, k in edges:
                ahead[e] = add_logs(ahead[e], ahead[s] + weight[k])
            for s, e, k in reversed(edges):
                way = weight[k] + behind[e]
                behind[s] = add_logs(behind[s], way)
                uses[k if k <= last else 0] += count * exp(ahead[s] + way - ahead[n])

    def fitted(self, uses: np.ndarray, kept: float = 1000.0) -> np.ndarray:
        """Log probabilities from expected uses and ``kept`` uses by the vocabulary's own weights."""
        return np.log((uses + kept * self.prior) / (uses.sum() + kept))


def _packed(node: dict) -> tuple[dict, int]:
    return {letter: _packed(child) for letter, child in node.items() if letter}, node.get("", 0)
