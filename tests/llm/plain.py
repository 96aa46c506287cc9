"""Plain versions that the operators are held against."""

import math
import re
from fractions import Fraction
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return set()
    width = min(words, len(tokens))
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def components(rows, words, percent=80):
    """Rows (id, text); the component of each row, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    usable = [i for i, s in enumerate(sets) if s and rows[i][0] is not None]
    for i, j in combinations(usable, 2):
        a, b = sets[i], sets[j]
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and find(i) != find(j):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                head[find(i)] = find(j)
    least = {}
    for i in usable:
        least[find(i)] = min(least.get(find(i), math.inf), rows[i][0])
    return [(rows[i][0], len(sets[i]), least[find(i)] if i in set(usable) else rows[i][0]) for i in range(len(rows))]


def tiktoken_of(path, pattern):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


BASE = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, holds) in enumerate(BASE) for m in pattern.finditer(text or "") if holds(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def least_guesses(cost, value, units, date, stand_ins):
    """Least cost of a value over all segmentations, each segment judged by itself."""
    n, low = len(value), value.lower()
    plain = low.translate(stand_ins)

    def segment(j, i):
        part, size = value[j:i], i - j
        costs = [float(size)]
        if 3 <= size <= cost.LONGEST_WORD and (word := cost._word(plain[j:i], part)) is not None:
            costs.append(word)
        if date.fullmatch(part):
            costs.append(math.log10(120 if size == 4 else 4 * 365 * 120))
        costs += [u + math.log10(size // u) for u in range(1, units + 1) if size % u == 0 and size >= 3 * u and part == part[:u] * (size // u)]
        if size >= 3 and all(low[k : k + 2] in cost.walks for k in range(j, i - 1)):
            costs.append(math.log10(94 * 4 * size))
        return min(costs)

    best = [0.0]
    for i in range(1, n + 1):
        best.append(min(best[j] + segment(j, i) + (cost.JOINT if j else 0) for j in range(i)))
    return best[n]


def node_importance(rows):
    """(host, path) to (pages, importance) for rows (url, html), each html once a host, by counting whole texts and child lists."""
    from collections import Counter, defaultdict
    from urllib.parse import urlsplit

    from tallyreef.llm import site_tree

    looks, reads, seen = defaultdict(list), defaultdict(list), set()
    for url, html in rows:
        host = (urlsplit(url).hostname or "") if url else ""
        if (host, html) in seen:
            continue
        seen.add((host, html))
        page = site_tree.parse(html)
        children, texts = defaultdict(list), defaultdict(list)
        own = defaultdict(list)
        for element, text in page.texts:
            if text is not None and text.strip():
                own[element].append(text.strip())
        below = [[] for _ in page.tags]
        for i in reversed(range(len(page.tags))):
            below[i] = [*own[i], *(x for j in [k for k, p in enumerate(page.parents) if p == i] for x in [tuple(below[j])] if x)]
        for i, path in enumerate(page.paths):
            texts[path].append(tuple(below[i]))
            if page.parents[i] >= 0:
                siblings = children[page.paths[page.parents[i]]]
                if not siblings or siblings[-1] != path:
                    siblings.append(path)
        for path in set(page.paths):
            looks[host, path].append(tuple(children[path]))
            reads[host, path].append(tuple(t for t in texts[path] if t))
    out = {}
    for key, shown in looks.items():
        n = len(shown)
        entropy = [-sum(c / n * math.log(c / n) for c in Counter(kind).values()) for kind in (shown, reads[key])]
        out[key] = (n, max(entropy) / math.log(n) if n > 1 else 1.0)
    return out


def sainte_lague(weights, seats, most):
    """Seats one after the other to the highest quotient, ties to the first."""
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [k for k, w in enumerate(weights) if w > 0 and out[k] < most[k]]
        if not open_:
            break
        out[min(open_, key=lambda k: (-Fraction(weights[k]) / (2 * out[k] + 1), k))] += 1
    return out


def spans(text, model, language_id):
    """Language, score and spans of a text: words one by one, and a Viterbi pass in plain arithmetic."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    rows, known = [], []
    for word in words:
        found = language_id.words_of([word])
        script = model.written[found.script[0]]
        scores = [sum(float(model.likelihood[t, k]) for t in found.trigrams) for k in range(len(model.languages))]
        rows.append([x if ok else min(scores) - 100 for x, ok in zip(scores, script, strict=True)] if script.any() else [0.0] * len(scores))
        known.append(bool(script.any()))
    if not words:
        return "und", 0.0, []
    best, back = [rows[0]], []
    for row in rows[1:]:
        top = max(range(len(row)), key=best[-1].__getitem__)
        came = [k if best[-1][k] >= best[-1][top] - language_id.SWITCH else top for k in range(len(row))]
        back.append(came)
        best.append([best[-1][c] - (0 if c == k else language_id.SWITCH) + x for k, (c, x) in enumerate(zip(came, row, strict=True))])
    path = [max(range(len(rows[0])), key=best[-1].__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    path.reverse()
    names = [model.languages[k] if ok else "und" for k, ok in zip(path, known, strict=True)]
    letters = {name: sum(len(w) for w, x in zip(words, names, strict=True) if x == name) for name in model.languages}
    first = max(model.languages, key=lambda x: letters[x])
    out = []
    for i, name in enumerate(names):
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], out[-1][1] + 1, name)
        else:
            out.append((i, 1, name))
    return first, letters[first] / sum(map(len, words)), out
