"""Packed sequences against plain lists, and the work and memory they take."""

import tracemalloc

import numpy as np
import pytest

from meridex.llm import lm, packed

VALUES = {
    "none": [], "zero": [0], "equal": [7] * 300, "dense": list(range(5000)), "gaps": [*range(0, 900, 3), 1 << 20, (1 << 20) + 1, 1 << 40, (1 << 62) + 5],
    "random": sorted(np.random.default_rng(1).integers(0, 1 << 60, 70_001).tolist()), "narrow": sorted(np.random.default_rng(2).integers(0, 50_000, 40_000).tolist()),
}


@pytest.mark.parametrize("name", VALUES)
def test_sequences_are_read_and_searched_as_coded(tmp_path, name):
    values = np.array(VALUES[name], np.uint64)
    raw = b"odd" + b"".join(x.tobytes() for x in packed.EliasFano.of(values).parts())
    (tmp_path / "level").write_bytes(raw)
    level, end = packed.EliasFano.read(np.memmap(tmp_path / "level", np.uint8, "r"), 3)
    assert end == len(raw) and level.at(np.arange(len(values))).tolist() == values.tolist()
    probes = np.unique(np.concatenate([values, values + np.uint64(1), values - (values > 0), np.array([0, 3, 1 << 61], np.uint64)]).astype(np.uint64))
    place, equal = level.successor(probes)
    assert place.tolist() == np.searchsorted(values, probes).tolist() and equal.tolist() == np.isin(probes, values).tolist()


@pytest.mark.parametrize("values", [[], [0], [127] * 9, [128], [0, 127, 128, 16383, 16384, 1 << 35, (1 << 63) + 9, (1 << 64) - 1, 5]])
def test_packed_values_come_back(values):
    assert packed.unpack_values(packed.pack_values(np.array(values, np.uint64))).tolist() == values
    assert packed.unpack_sorted(packed.pack_sorted(np.array(sorted(values), np.uint64))).tolist() == sorted(values)


def test_lower_bits_are_cut_without_a_matrix_of_all():
    values = np.cumsum(np.full(400_000, 1 << 20, np.uint64), dtype=np.uint64)
    tracemalloc.start()
    packed.EliasFano.of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(values)


def test_a_context_is_looked_up_once_for_its_pairs(tmp_path, monkeypatch):
    context, successor = np.repeat(np.arange(10, dtype=np.uint64) * np.uint64(99), 1000), np.tile(np.arange(1000, dtype=np.uint64), 10)
    lm.Trie.write(str(tmp_path / "trie"), context, successor, np.ones(10_000, np.int64))
    trie = lm.Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))
    asked, plain = [], packed.EliasFano.successor
    monkeypatch.setattr(packed.EliasFano, "successor", lambda self, values: (self is trie.words and asked.append(len(values))) or plain(self, values))
    order = np.random.default_rng(3).permutation(10_000)
    assert (trie.find(context, successor) == trie.find(context[order], successor[order])[np.argsort(order)]).all()
    assert (trie.find(context, successor) < 255).all() and (trie.find(context + np.uint64(1), successor) == 255).all()
    assert asked[0] == asked[2] == asked[3] == 10


def test_lots_are_merged_a_few_times(monkeypatch):
    sorted_values, plain = [], packed.distinct
    monkeypatch.setattr(packed, "distinct", lambda x: sorted_values.append(len(x)) or plain(x))
    lots = np.random.default_rng(4).integers(0, 1 << 60, (400, 5000)).astype(np.uint64)
    found = packed.Distinct()
    for lot in lots:
        found.add(lot)
    assert (found.all() == np.unique(lots)).all() and sum(sorted_values) < 6 * lots.size and packed.Distinct().all().tolist() == []
