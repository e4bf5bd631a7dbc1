"""Noise of few kinds of characters: whole texts of it, and parts of prose."""

from __future__ import annotations

import base64
import random
import string

import pytest
import zstandard

from fieldtally.llm import quality

PACKER = zstandard.ZstdCompressor(level=3)
SYLLABLES = [a + b + c for a in "bdfgklmnprstv" for b in "aeiou" for c in ("", "n", "r", "s")]


def judged(text):
    return quality.judge(text, quality.Rules(), quality.Bands(), PACKER)


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(["", " "]) + r.choice(SYLLABLES) for _ in range(n))[:n]


def base64_noise(n, seed):
    return base64.b64encode(random.Random(seed).randbytes(n)).decode()[:n]


def alphanumeric(n, seed):
    return "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n))


def worded(noise, n, seed):
    """Words of 40 characters, so that the word rules have nothing to say."""
    text = noise(n, seed)
    return " ".join(text[i : i + 40] for i in range(0, n, 41))[:n]


@pytest.mark.parametrize("noise", [base64_noise, alphanumeric])
@pytest.mark.parametrize("n", [600, 1000, 2048, 5000, 40_000])
def test_noise_is_rejected_and_prose_kept(noise, n):
    for seed in range(20):
        assert not judged(worded(noise, n, seed))[-1] and judged(prose(n, seed))[-1]


@pytest.mark.parametrize("noise", [base64_noise, alphanumeric])
@pytest.mark.parametrize("share", [0.35, 0.5, 2 / 3])
@pytest.mark.parametrize("place", [0, 0.5, 1])
def test_noise_within_prose_is_rejected(noise, share, place):
    n = 36_876
    text, junk = prose(n - int(n * share), 3), worded(noise, int(n * share), 4)
    at = int(len(text) * place)
    mixed = judged(text[:at] + junk + text[at:])
    assert not mixed[5] and mixed[-2] > 0.25 and not mixed[-1]


@pytest.mark.parametrize("noise", [base64_noise, alphanumeric])
@pytest.mark.parametrize("n, junk", [(2048 + 1950, 1950), (2048 + 900, 900), (3 * 2048 - 1, 2047), (2 * 2048 + 1700, 1700)])
def test_noise_behind_the_last_full_chunk_is_rejected(noise, n, junk):
    for seed in range(10):
        mixed = judged(prose(n - junk, seed) + worded(noise, junk, seed))
        assert not mixed[5] and mixed[-2] > 0.25 and not mixed[-1] and judged(prose(n, seed))[-1]


def test_every_byte_is_judged():
    assert judged(alphanumeric(700, 1))[-2] == judged("ab " * 300)[-2] == 1
    assert judged(prose(700, 1))[-2] == judged("")[-2] == 0
