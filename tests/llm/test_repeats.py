import numpy as np

from skylattice.llm import repeats, suffix_array

PLAN = repeats.Plan(repeats.ByteUnits, 12, 4)


def contexts(rng, shared):
    """Contexts of one anchor in random letters, some with the same letters next to it."""
    out = []
    for _ in range(6):
        left, right = (bytes(rng.integers(97, 123, 8, dtype=np.uint8)) for _ in range(2))
        a, b = rng.integers(0, 9, 2)
        out.append((left[: 8 - a] + shared[0][8 - a :] + b"ANCH" + shared[1][:b] + right[b:], 8, int(rng.integers(1, 3))))
    return list(dict.fromkeys(out))


def test_suffix_array_gets_all_recurring_windows_and_no_context_without_a_partner():
    rng, dropped = np.random.default_rng(7), 0
    for _ in range(60):
        groups = [contexts(rng, [bytes(rng.integers(97, 123, 8, dtype=np.uint8)) for _ in range(2)]) for _ in range(3)]
        told, _ = repeats.candidates([[c[:2] for c in g] for g in groups], PLAN)
        for group, own in zip(groups, told):
            windows = [{(b - s, c[s : s + 12]): s for s in range(len(c) - 11)} for c, b, _ in group]
            for i, (a, b) in enumerate(own):
                twice = [s for w, s in windows[i].items() if any(w in other for j, other in enumerate(windows) if j != i)]
                assert all(a <= s and s + 12 <= b for s in twice)
                assert b <= len(group[i][0])
                dropped += not b and not twice
    assert dropped > 60
    assert repeats.candidates([[(b"abcdefghANCHabcdefgh", 8)], [(b"abcdefghANCHabcdefgh", 8)]], PLAN)[0] == [[(0, 0)], [(0, 0)]]


def test_suffix_array_of_blocks_orders_the_starts_of_windows_only():
    rng = np.random.default_rng(5)
    for most in (1, 7, 10, 40):
        for _ in range(20):
            blocks = [rng.integers(0, 2, rng.integers(1, 60)) for _ in range(4)]
            text = np.concatenate([np.append(b, 2) for b in blocks])
            ends = np.cumsum([len(b) + 1 for b in blocks]) - 1
            room = np.repeat(ends, [len(b) + 1 for b in blocks]) - np.arange(len(text))
            order, ranks = suffix_array.suffix_array(text, room, most)
            window = {int(i): tuple(text[i : i + most]) for i in np.flatnonzero(room >= most)}
            assert sorted(order.tolist()) == sorted(window)
            assert [window[i] for i in order.tolist()] == sorted(window.values())
            for h, rank in ranks:
                for i in window:
                    for j in window:
                        assert (rank[i] == rank[j]) == (tuple(text[i : i + h]) == tuple(text[j : j + h]))
