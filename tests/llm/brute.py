"""Plain versions of what the operators do, for small tables."""

import numpy as np
import pyarrow as pa

from wordloom.llm import kernels as K
from wordloom.llm.decontaminate import LeakConfig


def hashes(text):
    return K.tokenize(pa.array([text or ""])).hash


def signature(text, words):
    """Bit by bit over the set of bigrams."""
    t = hashes(text)
    if len(t) == 0:
        return None
    grams = K.ngrams(K.tokenize(pa.array([text])), 2)[0] if len(t) > 1 else t
    bits = np.uint64(K.SLICE_ROWS.bit_length())
    own = {int(K.mix(np.array([g >> bits << bits], np.uint64))[0]) for g in grams}
    out = []
    for seed in words:
        for b in range(64):
            ones = 0
            for g in own:
                h = int(K.mix(np.array([g ^ seed], np.uint64))[0]) if seed else g
                ones += h >> b & 1
            out.append(2 * ones > len(own))
    return out


def quality(text, vectors, output, bias, config):
    """Probability of good: the mean of the vectors of all features of a text, one by one, and a softmax; 0 without a feature."""
    mask, top = (1 << 64) - 1, 64 - config.bits

    def mixed(h):
        return int(K.mix(np.array([h & mask], np.uint64))[0])

    def hashed(word):
        return mixed(sum((b + 1) * pow(K._P, k, 1 << 64) for k, b in enumerate(word)) + len(word))

    words = (text or "").encode().split()
    rows = [hashed(w) for w in words]
    ids = [h >> top for h in rows]
    ids += [mixed((a * 0xD6E8FEB86659FD93 + b) ^ 0xA24BAED4963EE407) >> top for a, b in zip(rows, rows[1:])]
    blanks = bytes(32 if b in b" \t\n\r\x0b\x0c" else b for b in (text or "").encode())
    for n in config.char_grams:
        for at in range(len(blanks) - n + 1):
            if b" " not in blanks[at + 1 : at + n - 1]:
                code = n
                for b in blanks[at : at + n]:
                    code = code * 0x01000193 % (1 << 32) ^ b
                ids.append(code * 0x9E3779B1 % (1 << 32) >> 32 - config.bits)
    if not ids:
        return 0.0
    mean = sum(vectors[i].astype(float) for i in ids) / len(ids)
    e = np.exp(mean @ output.astype(float) + bias)
    return float(e[1] / e.sum())


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def leaks(docs, items, config=LeakConfig()):
    """(doc_id, item_id) by trying every alignment of every item."""
    found = set()
    for item_id, text in items:
        item = hashes(text)
        size = len(item)
        if size == 0:
            continue
        width = min(size, config.window)
        for doc_id, body in docs:
            doc = hashes(body)
            padded = np.concatenate((np.zeros(size, np.uint64), doc, np.zeros(size, np.uint64)))
            same = np.stack([padded[k : len(padded) - size + 1 + k] == item[k] for k in range(size)], axis=1)
            total = np.concatenate((np.zeros((len(same), 1), int), np.cumsum(same, axis=1)), axis=1)
            if len(doc) and (total[:, width:] - total[:, : size + 1 - width]).max() >= np.ceil(config.overlap * width - 1e-9):
                found.add((doc_id, item_id))
    return found


def licenses(text, model):
    """(paragraph, start, length, family, probability, similarity, confirmed) of the licence paragraphs of a text, word by word."""
    config, mask = model.config, (1 << 64) - 1
    tok = K.tokenize(pa.array([text or ""]))
    data, words = tok.data.tobytes(), list(zip(tok.hash.tolist(), tok.start.tolist(), tok.end.tolist()))

    def mixed(h):
        return int(K.mix(np.array([h & mask], np.uint64))[0])

    def grams(a, b, order):
        out = []
        for i in range(a, b - order + 1):
            h = words[i][0]
            for k in range(1, order):
                h = h * 0xD6E8FEB86659FD93 + words[i + k][0]
            out.append(h if order == 1 else mixed(h))
        return out

    def linear(a, b, orders, vocabulary, weights, bias):
        known = {h: i for i, h in enumerate(vocabulary.hashes.tolist())}
        found = [g for n in orders for g in grams(a, b, n)]
        total = sum((weights[known[g]].astype(float) for g in found if g in known), np.zeros(weights.shape[1]))
        return total / np.sqrt(max(1, len(found))) + bias

    def family(a, b):
        z = linear(a, b, (1, 2, 3), model.words, model.weights, model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best, own = int(p[1:].argmax()) + 1, set(grams(a, b, 2))
        alike = {}
        for k, template in model.templates:
            if len(own) > 1:
                alike[k] = max(alike.get(k, 0), len(own & set(template.tolist())) / min(len(own), len(template)))
        return best, p[best], p[0], alike

    def ends(i):
        """Whether a line or sentence ends between the words i - 1 and i."""
        return any(data[x] == 10 or data[x] in b".!?" and data[x + 1 : x + 2] in (b" ", b"\t", b"\r") for x in range(words[i - 1][1], words[i][1]))

    units, size = [], 0
    for i in range(len(words)):
        fresh = i == 0 or ends(i)
        size = 0 if fresh else size + 1
        if fresh or size % config.unit_tokens == 0:
            units.append(i)
    units.append(len(words))
    parts, held = [], 0
    for a, b in zip(units, units[1:]):
        if linear(a, b, (1, 2), model.gate_words, model.gate, model.gate_bias)[0] < np.log(config.gate / (1 - config.gate)):
            continue
        gap = data[words[a - 1][2] - 1 : words[a][1]] if a else b""
        joined = bool(parts) and parts[-1][1] == a and not any(not line.strip(b" \t\r") for line in gap.split(b"\n")[1:-1])
        best, p, other, alike = family(a, b)
        sure = other < 0.5 and p >= model.threshold and alike.get(best, 0) >= config.overlap
        held = held if joined else 0
        if sure and held and best != held and alike[best] > alike.get(held, 0):
            joined, held = False, 0
        if sure:
            held = held or best
        if joined:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    out = []
    for a, b in parts:
        best, p, other, alike = family(a, b)
        if other < 0.5:
            sure = bool(p >= model.threshold and alike.get(best, 0) >= config.overlap)
            at, length = (len(data[x:y].decode("utf-8", "ignore")) for x, y in ((0, words[a][1]), (words[a][1], words[b - 1][2])))
            out.append((len(out) + 1, at, length, model.names[best] if sure else "unknown", round(float(p), 3), round(float(alike.get(best, 0)), 4), sure))
    return out
