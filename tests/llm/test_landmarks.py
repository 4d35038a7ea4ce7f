"""Landmarks of the toxicity operator: every significant family has one."""

import random

from molquarry.llm import toxicity


def test_every_family_of_insults_has_a_landmark():
    rng = random.Random(1)
    stems = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(40)]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    toxic = [f"{word()} {s} {word()} {word()}." for s in stems for _ in range(30 if s in stems[:30] else 28)]
    fine = [f"{word()} {word()} {word()}." for _ in range(1200)]
    assert {toxicity.START + s for s in stems} <= set(toxicity.landmarks_of(toxic, fine))


def test_words_of_other_scripts_are_words():
    assert toxicity.clean("«Дурак!»") == toxicity.START + "дурак".replace("д", "Д")
    assert toxicity.clean("12-bocoós_") == toxicity.START + "bocoós" and toxicity.clean("1_2.") == ""
