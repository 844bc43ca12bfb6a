"""Line differences by Myers' greedy algorithm, and their unified form."""

from __future__ import annotations


def lines_of(text: str) -> list[str]:
    """A text's lines, whatever ends them; a last line end begins no further line."""
    if not text:
        return []
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The shortest list of (' ' | '-' | '+', line) that turns a into b."""
    # What begins and ends alike needs no search.
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x_end, y_end = len(a) - tail - head, len(b) - tail - head
    mid_a, mid_b = a[head : head + x_end], b[head : head + y_end]
    reach = {1: 0}
    trail: list[dict[int, int]] = []
    for d in range(x_end + y_end + 1):
        trail.append(dict(reach))
        done = False
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < x_end and x - k < y_end and mid_a[x] == mid_b[x - k]:
                x += 1
            reach[k] = x
            if x >= x_end and x - k >= y_end:
                done = True
                break
        if done:
            break
    back: list[tuple[str, str]] = []
    x, y = x_end, y_end
    for d in range(len(trail) - 1, 0, -1):
        seen, k = trail[d], x - y
        came = k + 1 if k == -d or (k != d and seen[k - 1] < seen[k + 1]) else k - 1
        px = seen[came]
        py = px - came
        while x > px and y > py:
            x, y = x - 1, y - 1
            back.append((" ", mid_a[x]))
        if x == px:
            y -= 1
            back.append(("+", mid_b[y]))
        else:
            x -= 1
            back.append(("-", mid_a[x]))
    back += [(" ", s) for s in reversed(mid_a[:x])]
    return [(" ", s) for s in a[:head]] + back[::-1] + [(" ", s) for s in a[len(a) - tail :]]


def unified(old_name: str, new_name: str, old: str, new: str, context: int = 3) -> str:
    """A unified difference; '' where no line differs. Each hunk names its first line and number of lines on either side."""
    edits = script(lines_of(old), lines_of(new))
    changed = [i for i, (op, _) in enumerate(edits) if op != " "]
    if not changed:
        return ""
    spans: list[list[int]] = []
    for i in changed:
        low, high = max(0, i - context), min(len(edits), i + context + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    out = [f"--- {old_name}", f"+++ {new_name}"]
    x = y = 1
    at = 0
    for low, high in spans:
        for op, _ in edits[at:low]:
            x, y = x + (op != "+"), y + (op != "-")
        hunk = edits[low:high]
        n, m = sum(op != "+" for op, _ in hunk), sum(op != "-" for op, _ in hunk)
        out.append(f"@@ -{x},{n} +{y},{m} @@")
        out += [op + text for op, text in hunk]
        x, y, at = x + n, y + m, high
    return "\n".join(out) + "\n"
