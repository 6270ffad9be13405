"""Plain versions of the learned operators, in loops over Python numbers and texts, for small tables."""

import math
import zlib
from collections import Counter

import numpy as np

from phasemesh.llm import langid, quality

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


# --- languages --------------------------------------------------------------------------------------------------------


def script(c):
    return next((i for i, (_, ranges) in enumerate(langid.SCRIPTS) if any(a <= ord(c) <= b for a, b in ranges)), None)


def word_pieces(word):
    """A word's letters, lower-cased; where there are more than 64, cut at changes of script and after each 64."""
    letters = "".join(c for c in word if c.isalpha()).lower() if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).lower().replace(" ", "")
    if len(letters) <= 64:
        return [letters] if letters else []
    out, now = [], None
    for i, c in enumerate(letters):
        s = script(c)
        s = now if s is None and i else s
        if i == 0 or s != now or len(out[-1]) == 64:
            out.append("")
        out[-1] += c
        now = s
    return out


def buckets(piece):
    """The order and bucket of every n-gram."""
    text = f" {piece} "
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(text) - n + 1):
            gram = text[i : i + n]
            if " " in gram[1:-1] or gram[0] == gram[-1] == " ":
                continue
            h = n
            for c in gram:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & M64
                h ^= h >> 29
            yield k, (h >> 40) & (langid.BUCKETS - 1)


class Languages:
    def __init__(self, rows):
        """``rows``: (text, lang) that may be learned from."""
        self.counts, heard, letters = {}, Counter(), Counter()
        for text, lang in rows:
            if text is not None and lang is not None:
                for word in text.split():
                    for p in word_pieces(word):
                        for k, b in buckets(p):
                            self.counts.setdefault((k, b), Counter())[lang] += 1
                            heard[k, lang] += 1
                        for c in p:
                            if script(c) is not None:
                                letters[lang, script(c)] += 1
        self.names = sorted({lang for _, lang in heard})
        self.base = {(k, x): math.log(langid.SMOOTHING / (heard[k, x] + langid.SMOOTHING * langid.BUCKETS)) for k in range(len(langid.ORDERS)) for x in self.names}
        all_letters = {x: sum(n for (lang, _), n in letters.items() if lang == x) for x in self.names}
        self.written = {(x, s) for (x, s), n in letters.items() if n >= max(1, 0.01 * all_letters[x])}
        self.memo = {}

    def scores(self, piece):
        if piece not in self.memo:
            total = dict.fromkeys(self.names, 0.0)
            for k, b in buckets(piece):
                here = self.counts.get((k, b), {})
                for x in self.names:
                    total[x] += self.base[k, x] + math.log1p(here.get(x, 0) / langid.SMOOTHING)
            seen = Counter(s for c in piece if (s := script(c)) is not None)
            main = max(sorted(seen), key=lambda s: seen[s], default=None)
            allowed = [x for x in self.names if (x, main) in self.written] or self.names
            self.memo[piece] = [total[x] / len(langid.ORDERS) - (0 if x in allowed else langid.FOREIGN) for x in self.names]
        return self.memo[piece]

    def say(self, text):
        """The language and its share of the letters."""
        words = [p for w in (text or "").split() for p in word_pieces(w)]
        if not words or not self.names:
            return "und", 0.0
        score, back = self.scores(words[0]), []
        for w in words[1:]:
            best = max(range(len(score)), key=lambda i: (score[i], -i))
            top = score[best] - langid.PENALTY
            back.append([i if score[i] >= top else best for i in range(len(score))])
            score = [max(s, top) + e for s, e in zip(score, self.scores(w))]
        label = max(range(len(score)), key=lambda i: (score[i], -i))
        weight = Counter({label: len(words[-1])})
        for w, b in zip(reversed(words[:-1]), reversed(back)):
            label = b[label]
            weight[label] += len(w)
        best = max(sorted(weight), key=lambda i: weight[i])
        return self.names[best], weight[best] / sum(weight.values())


# --- quality ----------------------------------------------------------------------------------------------------------


def features(text):
    """The distinct n-grams of a text, each by its place in the model."""
    codes = [divmod(quality._form(w), 1 << 32) for w in (text or "").split()]
    word = [w for w, _ in codes]
    form = []
    for i, (w, f) in enumerate(codes):
        f = ((f ^ (0x9E3779B9 if i and word[i - 1] == w else 0)) * 0x85EBCA6B) & M32
        form.append(f ^ f >> 15)
    out = {((w * 0x9E3779B1) & M32) >> 32 - quality.WORD_BITS for w in word}
    for n in range(4):
        for i in range(len(form) - n):
            run = 0
            for f in form[i : i + n + 1]:
                run = ((run * 0x01000193) & M32) ^ f
            out.add((((run * 0xC2B2AE35) & M32) >> 32 - quality.FORM_BITS) + (1 << quality.WORD_BITS) + n * (1 << quality.FORM_BITS))
    for a, b in zip(word, word[1:]):
        p = ((a * 0x85EBCA6B) & M32) ^ b
        p ^= p >> 15
        out.add((((p * 0xC2B2AE35) & M32) >> 32 - quality.PAIR_BITS) + quality.PAIRS)
    return out


class Quality:
    def __init__(self, rows):
        """``rows``: (text, label) in order of doc_id."""
        seen, labels = [features(t) for t, _ in rows], [y for _, y in rows]
        n = Counter(labels)
        counts = {y: Counter(f for s, x in zip(seen, labels) if x == y for f in s) for y in (0, 1)}
        self.ratio = {}
        for f in counts[0].keys() | counts[1].keys():
            if counts[0][f] + counts[1][f] > 1:
                self.ratio[f] = math.log((1 + counts[1][f]) / (n[1] + 2)) - math.log((1 + counts[0][f]) / (n[0] + 2))
        vectors = [self.unit(s) for s in seen]
        self.weight, self.bias, alpha = Counter(), 0.0, [0.0] * len(rows)
        rng = np.random.default_rng(0)
        for _ in range(quality.EPOCHS):
            most = 0.0
            for i in rng.permutation(len(rows)):
                v, y = vectors[i], 2 * labels[i] - 1
                slope = y * (sum(self.weight[f] * x for f, x in v.items()) + self.bias) - 1
                bound = quality.COST * len(rows) / (2 * n[labels[i]])
                new = min(max(alpha[i] - slope / (sum(x * x for x in v.values()) + 1), 0.0), bound)
                step, alpha[i] = new - alpha[i], new
                most = max(most, abs(step))
                for f, x in v.items():
                    self.weight[f] += step * y * x
                self.bias += step * y
            if most < 1e-3:
                break

    def unit(self, seen):
        held = {f: self.ratio[f] for f in sorted(seen) if self.ratio.get(f)}
        norm = math.sqrt(sum(r * r for r in held.values()))
        return {f: r / norm for f, r in held.items()}

    def score(self, text):
        margin = self.bias + sum(self.weight[f] * x for f, x in self.unit(features(text)).items())
        return 1 / (1 + math.exp(-min(max(quality.SHARPNESS * margin, -50), 50)))


def held_out(doc_id, n, rest):
    return zlib.crc32(str(doc_id).encode()) % n == rest
