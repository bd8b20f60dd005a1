"""The flagging processor over a state of its own: few calls a batch, and the same statuses however it is held."""

import random

import pandas as pd
import pytest

from tidemark.streaming import streams


class Variable:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key] = value


class Handle:
    def __init__(self):
        self.variables = []

    def getMapState(self, *_):  # noqa: N802
        self.variables.append(Variable())
        return self.variables[-1]


class Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def items(n, seed=3):
    r, out, fps = random.Random(seed), [], []
    for i in range(n):
        fp = r.getrandbits(64)
        if fps and r.random() < 0.3:
            fp = r.choice(fps)
            for bit in r.sample(range(64), r.choice([0, 2, 3, 4])):
                fp ^= 1 << bit
        fps.append(fp)
        out.append((i, i // 2, r.choice(["a", "b", None]), f"u{r.randrange(n)}" if r.random() < 0.5 else None, None if r.random() < 0.05 else f"t{r.randrange(4 * n)}", f"w{r.randrange(50)}" if r.random() < 0.9 else None, fp - (1 << 64) if fp >> 63 else fp))
    return pd.DataFrame(out, columns=["doc_id", "published_at", "community", "canon", "text_key", "author_hash", "fp"])


def model(rows):
    urls, texts, fps, seen, out = {}, set(), [], set(), []
    for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
        first = urls.setdefault(r.canon, r.community) if r.canon in urls or r.canon is None else None
        if r.canon is not None and r.canon in urls:
            out.append("duplicate_url" if first == r.community else "crosspost")
            continue
        urls[r.canon] = r.community
        status = "unique"
        if r.text_key is not None:
            if r.text_key in texts:
                status = "duplicate_exact"
            elif any(((r.fp ^ x) & (1 << 64) - 1).bit_count() <= 3 for x in fps):
                status = "near_duplicate"
            else:
                fps.append(r.fp)
            texts.add(r.text_key)
        if status != "unique" and r.author_hash is not None:
            status = "bot_repeat" if r.author_hash in seen else status
            seen.add(r.author_hash)
        out.append(status)
    return out


def flagged(rows, sizes, ttl=None, times=None):
    handle, got, at = Handle(), [], 0
    own = streams._Flagging(3, ttl)
    own.init(handle)
    for k, n in enumerate(sizes):
        for x in own.handleInputRows(("s",), iter([rows[at : at + n]]), Timers(times[k] if times else 0)):
            got += list(x["status"])
        at += n
    return got, sum(v.calls for v in handle.variables)


@pytest.mark.parametrize("held", [None, 40])
def test_statuses_however_batches_and_memory_are_cut(monkeypatch, held):
    if held:
        monkeypatch.setattr(streams, "HELD", held)
    rows = items(700)
    wanted = model(rows)
    assert len(set(wanted)) == 6
    for sizes in ((700,), (1, 99, 600), (350, 350)):
        assert flagged(rows, sizes)[0] == wanted


def test_a_large_batch_makes_no_call_to_state_for_each_item(monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 64, raising=False)
    got, calls = flagged(items(4000), (4000,))
    # no more than the buckets of three maps and of four parts
    assert len(got) == 4000 and calls < 600


def test_entries_are_forgotten_one_by_one():
    one = pd.DataFrame([(1, 1, "a", "u", "t1", None, 5), (2, 2, "a", None, "t2", None, -1)], columns=["doc_id", "published_at", "community", "canon", "text_key", "author_hash", "fp"])
    rows = pd.concat([one, one.assign(canon=None), one.assign(canon=None), one], ignore_index=True)
    got, _ = flagged(rows, (2, 2, 2, 2), ttl=100, times=[0, 99, 100, 150])
    assert got == ["unique", "unique", "duplicate_exact", "duplicate_exact", "unique", "unique", "duplicate_exact", "duplicate_exact"]
