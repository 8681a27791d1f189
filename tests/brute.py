"""The matching rules restated over plain Python values, for comparison in tests."""

DELETED = set("'-.,:;()/")


def norm(text):
    words = ["".join(c for c in word if c not in DELETED) for word in text.split()]
    return " ".join(w for w in words if w and w != "Real" and not w.isdigit()).lower()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        above, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return row[-1]


def abbreviates(short, long):
    if not short:
        return True
    if long[:1] != short[0]:
        return False
    reached = {0}
    for char in short[1:]:
        onward = set()
        for at in reached:
            end = long.find(" ", at + 1)
            end = len(long) if end < 0 else end
            onward |= {q for q in range(at + 1, min(end + 1, len(long))) if long[q] == char}
            if long[end + 1 : end + 2] == char:
                onward.add(end + 1)
        reached = onward
    return bool(reached)


def overlap(a, b, least=0.5):
    xs, ys = a.split(), b.split()
    return bool(xs and ys) and sum(x == y for x in xs for y in ys) / (len(xs) * len(ys)) >= least


RULES = {
    "exact": lambda x, y: x == y,
    "edit": lambda x, y: distance(x, y) <= 2,
    "abbrev0": abbreviates,
    "abbrev1": lambda x, y: abbreviates(y, x),
    "token": overlap,
}


def resolve(text, entities, rules=tuple(RULES)):
    """(entity, strategy) for a list of (name, alternatives), else (None, None)."""
    x = norm(text)
    for rule in rules:
        for name, others in entities:
            if any(RULES[rule](x, norm(alias)) for alias in [name, *others]):
                return name, rule
    return None, None
