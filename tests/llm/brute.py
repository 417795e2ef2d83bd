"""Plain versions of the operators, for small tables."""

import itertools
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text, k=5):
    w = SPACED.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(rows, percent):
    """rows: (id, text); {id: (set size, smallest id reachable)}; ids are distinct and not null."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def passages(docs, items, window=10):
    """[(words, hit words, items)] of the texts; items: (id, text)."""
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        m = min(len(w), window)
        if i is not None and m:
            for s in range(len(w) - m + 1):
                windows[tuple(w[s:s + m])].add(str(i))
    out = []
    for text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[s:s + m]))) is not None:
                    hit.update(range(s, s + m))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def repeats(rows, window=20):
    """{id: (words, removed words, kept text)}; ids are distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = SPACED.findall(text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            run = tuple(w[s:s + window])
            if run in seen:
                gone.update(range(s, s + window))
            seen.add(run)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def base_spans(text):
    text = text or ""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(float(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0,
                  "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


class ContextTree:
    """Context-tree weighting as its definition states it, by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for data in texts:
            for context, byte in self.symbols(data):
                node = 1
                for j in range(7, -1, -1):
                    bit = byte >> j & 1
                    for d in range(depth + 1):
                        self.counts[context[:d], node][bit] += 1
                    node = node << 1 | bit
        self.longer = defaultdict(set)
        for context, node in self.counts:
            if context:
                self.longer[context[:-1], node].add(context)
        self.memo = {}

    def symbols(self, data):
        for i, byte in enumerate(data):
            before = (bytes([10]) * self.depth + data[:i])[-self.depth:]
            yield bytes(reversed(before)), byte

    def own(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, context, node):
        key = context, node
        if key not in self.memo:
            own = self.own(key)
            if len(context) < self.depth:
                longer = sum(self.weighted(c, node) for c in self.longer[key])
                top = max(own, longer)
                own = top + math.log(math.exp(own - top) / 2 + math.exp(longer - top) / 2)
            self.memo[key] = own
        return self.memo[key]

    def p(self, context, node, bit, d=0):
        """Predictive probability of a bit: the mixture that the weighted probabilities imply."""
        key = context[:d], node
        if key not in self.counts:
            return 0.5
        a, b = self.counts[key]
        own = ((a, b)[bit] + .5) / (a + b + 1)
        if d == self.depth:
            return own
        share = math.exp(self.own(key) - math.log(2) - self.weighted(*key))
        return share * own + (1 - share) * self.p(context, node, bit, d + 1)

    def log10(self, data):
        total = 0.0
        for context, byte in self.symbols(data):
            node = 1
            for j in range(7, -1, -1):
                bit = byte >> j & 1
                total += math.log10(self.p(context, node, bit))
                node = node << 1 | bit
        return total


def licenses(text, templates, threshold):
    def pairs(t):
        w = ALNUM.findall(lower(t))
        return set(zip(w, w[1:]))

    lines = (text or "").split("\n")
    units = [(i, pairs(line)) for i, line in enumerate(lines)]
    if sum(bool(ALNUM.search(lower(line))) for line in lines) > 1:
        units.append((-1, pairs(text)))
    out = []
    for i, unit in units:
        for name, template in templates.items():
            t = pairs(template)
            if unit and t and (dice := 2 * len(unit & t) / (len(unit) + len(t))) >= threshold:
                out.append((name, dice, i))
    return out


def counts(texts):
    return Counter(w for t in texts for w in [*SPACED.findall(lower(t)), None])
