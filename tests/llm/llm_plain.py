"""Plain code that says what the operators must return."""

import re

WS = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_ws(text):
    return WS.findall(text)


def shingles(text, k):
    w = WS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(texts, k, p, q):
    """doc -> (size of its set, smallest doc that links reach), by looking at all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and q * min(len(a), len(b)) >= p * max(len(a), len(b)) and q * len(a & b) >= p * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def licenses(text):
    w = WORD.findall((text or "").translate(LOWER))
    found = [(k, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def license_spans(text, templates, cover, drift):
    """Labels of templates found, and the largest cover, by looking at each template's runs of near diagonals."""
    w = WORD.findall((text or "").translate(LOWER))
    labels, best = set(), 0.0
    for phrase, label in templates:
        t = phrase.split()
        hits = sorted((i - j, j, i) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2])
        runs, last = [], None
        for d, j, i in hits:
            if last is None or d - last > drift:
                runs.append([])
            runs[-1].append((j, i))
            last = d
        for run in runs:
            share = len({x for j, _ in run for x in (j, j + 1)}) / len(t)
            if share >= cover and max(i for _, i in run) + 1 - min(i for _, i in run) + 1 <= len(t) * (2 - cover) + drift:
                labels.add(label)
                best = max(best, share)
    return labels, best


def url_tree(rows, share, support, prior, z, names):
    """(template, purity) of each (host, path, bad or None), node by node."""
    kind = lambda s: "{n}" if re.match(r"^[0-9]+(\.[A-Za-z]+)?$", s) else "{hex}" if re.match("^[0-9a-fA-F-]{8,}$", s) else "{mixed}" if re.search("[0-9]", s) else "{*}"
    count = lambda ks: (len(ks), sum(rows[k][2] is not None for k in ks), sum(bool(rows[k][2]) for k in ks))
    segs = [[s for s in p.split("/") if s] for _, p, _ in rows]
    _, labelled, bad = count(range(len(rows)))
    base = (bad + 1) / (labelled + 2)
    out = [None] * len(rows)

    def visit(ks, template, above, depth):
        n, lab, bad = count(ks)
        own = (bad + prior * above) / (lab + prior)
        stay = [k for k in ks if n < support or len(segs[k]) < depth]
        for k in stay:
            out[k] = template, own
        if n < support:
            return
        by = {}
        for k in ks:
            if len(segs[k]) >= depth:
                by.setdefault(re.sub(r"([{}|$\\])", r"\\\1", segs[k][depth]) if len(segs[k]) > depth else "$", []).append(k)
        branches = {}
        for s, own_ks in by.items():
            m, lb, _ = count(own_ks)
            keep = s == "$" or m >= max(support, n * share) or lb >= support
            branches.setdefault(s if keep else kind(s), []).extend(own_ks)
        rate = lambda b, lb: (b + prior * own) / (lb + prior)
        spread = lambda b, lb: max(rate(b, lb) * (1 - rate(b, lb)), 0.01) / (lb + prior)
        runs, held = [], (0, 0)
        for name in sorted(branches, key=lambda x: (rate(count(branches[x])[2], count(branches[x])[1]), count(branches[x])[1:])):
            _, lb, b = count(branches[name])
            # Branches with equal counts are one step of the sweep.
            if runs and (lb, b) == last:
                runs[-1].append(name)
                held = (held[0] + b, held[1] + lb)
                continue
            if not runs or abs(rate(b, lb) - rate(*held)) >= z * (spread(b, lb) + spread(*held)) ** 0.5:
                runs.append([])
                held = (0, 0)
            runs[-1].append(name)
            held, last = (held[0] + b, held[1] + lb), (lb, b)
        for run in runs:
            own_ks = [k for name in run for k in branches[name]]
            some = sorted(run)[:names]
            text = run[0] if len(run) == 1 else "{" + "|".join(some) + (f"|+{len(run) - names}" if len(run) > names else "") + "}"
            visit(own_ks, f"{template}/{text}", own, depth + 1)

    for host in {h for h, _, _ in rows}:
        visit([k for k, r in enumerate(rows) if r[0] == host], host, base, 0)
    return out
