import random

from logweave.llm import fingerprints as P


def line(seed, n=60):
    rnd = random.Random(seed)
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 1)) + "\n"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def like(a, b):
    return P.likeness([(P.fingerprint(a.encode()), P.fingerprint(b.encode()))])[0]


def test_the_block_is_halved_until_the_signature_is_long_enough():
    for text in [line(k) * 1000 for k in range(20)] + [line(1) * 300 + prose(2, 100), prose(3, 5000), "a" * 50_000]:
        block, found = P.signatures(P.fingerprint(text.encode()))
        assert block == P.LEAST_BLOCK or len(found[block]) >= P.LENGTH // 2
        assert all(len(s) <= P.LENGTH for s in found.values())


def test_another_number_of_repetitions_shows():
    prints = {n: P.fingerprint((line(3) * n).encode()) for n in (40, 41, 400)}
    assert len(set(prints.values())) == 3


def test_near_copies_of_repetitive_texts():
    for k in range(20):
        one, other = line(k) * 1000, line(k + 100) * 1000
        assert like(one, line(k) * 999 + line(k + 200)) > 0.3
        assert like(one, one[:30_000] + other[:30_000]) > 0.2
        assert like(one, other) < 0.4


def test_what_follows_a_run_counts():
    """A run of equal pieces takes one character, so the signature reaches the prose behind it.

    Of lines that repeat as a sequence of pieces that is not so: they are text like any other.
    """
    ends = [prose(k, 60) for k in range(3)]
    one, near, far = "-" * 30_000 + ends[0], "-" * 30_000 + ends[0] + " more", "-" * 30_000 + ends[1]
    assert like(one, near) > 0.8 and like(one, near) > like(one, far) + 0.2
