"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

BLANK = " \t\n\x0b\x0c\r"


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


class Groups:
    """Union of the things that were linked; the least one names a group."""

    def __init__(self, things):
        self.above = {t: t for t in things}

    def name(self, t):
        while self.above[t] != t:
            t = self.above[t]
        return t

    def link(self, a, b):
        a, b = sorted((self.name(a), self.name(b)))
        self.above[b] = a


def edits_for(length, edits=1, longer=((50, 2), (100, 4))):
    """The edits that two lines may differ by, the shorter of which has so many characters."""
    return max([edits, *[more for least, more in longer if length >= least]])


def dropped_lines(rows, edits=1, least=20, longer=((50, 2), (100, 4))):
    """Numbers of dropped lines by document, for rows of number and text."""
    lines = [(i, pos, line) for i, t in rows for pos, line in enumerate((t or "").split("\n")) if line.strip(BLANK)]
    letters = [Counter(line) for _, _, line in lines]
    groups = Groups(range(len(lines)))
    for x in range(len(lines)):
        for y in range(x):
            a, b = lines[x][2], lines[y][2]
            most = edits_for(min(len(a), len(b)), edits, longer)
            near = min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= most
            # an edit changes the count of two characters at most
            near = near and a != b and sum(((letters[x] - letters[y]) + (letters[y] - letters[x])).values()) <= 2 * most
            if a == b or near and edit_distance(a, b) <= most:
                groups.link(x, y)
    first, dropped = {}, {}
    for k, (i, pos, _) in enumerate(lines):
        first[groups.name(k)] = min(first.get(groups.name(k), (i, pos)), (i, pos))
    for k, (i, pos, _) in enumerate(lines):
        if first[groups.name(k)] != (i, pos):
            dropped.setdefault(i, set()).add(pos)
    return dropped


def bag(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def near_groups(rows, similarity=0.8):
    bags = {i: bag(t) for i, t in rows}
    groups = Groups(bags)
    for i in bags:
        for j in bags:
            if j < i and bags[i] and bags[j]:
                if sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values()) >= similarity:
                    groups.link(i, j)
    return {i: groups.name(i) for i in bags}


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        x = int(c) * (1 + place % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            counts = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }
            if counts[kind]():
                out.append((kind, m.start(), m.end()))
    return out
