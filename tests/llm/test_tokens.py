"""The piece encoder against the plain call on whole texts, and random access to token files."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowtide.llm import queries, token_files, tokens
from flowtide.plans.materialise import materialise, scratch_path
from tests.llm import brute

VOCABULARIES = [("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "leading")]
MARKS = "aAbBzZ\u0130\u0131\u00e9\u00c9\u0301\u0307,,..  \n\t \u3000'st\u00df0\u00bd\u00b2\u01f0\u03a3\u03c2\u0939\u093f\u200b<|>"
ADDED = ("<|endoftext|>", "<|startoftext|>", "<|endoftext")
RANGES = [*range(32, 0x250), *range(0x300, 0x400), *range(0x900, 0x980), *range(0x2000, 0x2070), *range(0x4E00, 0x4E20)]


def random_texts(n):
    draw = random.Random(5)

    def piece():
        kind = draw.random()
        return draw.choice(ADDED) if kind < 0.04 else draw.choice(MARKS) if kind < 0.7 else chr(draw.choice(RANGES))

    return ["".join(piece() for _ in range(draw.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("memory", [300_000, 300])
@pytest.mark.parametrize("name,cut", VOCABULARIES)
def test_ids_of_any_text(name, cut, memory, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", memory)
    path = queries.tokenizer_file(name)
    made, plain = tokens.PieceEncoder(path, cut), Tokenizer.from_file(path)
    texts = [*random_texts(20_000), "AL\u0130, VEL\u0130.", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>"]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        want = [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in made.encode(some)] == want


ROWS = [(1, "The first text."), (1, "The first text."), (2, None), (3, ""), (None, " \n\t "), (4, "word, " * 300_000), (5, "x<|endoftext|>y")]


def test_token_files_of_edge_rows(spark):
    """Nulls, repeats and a text of many batches; each sequence is found by a division, ids and mask without a copy."""
    path = queries.tokenizer_file("byte_bpe_50k.json")

    def written(rows):
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, name string")
        folder = scratch_path(spark, "token_test")
        shards = materialise(token_files.write_token_files(docs, folder, path, "leading", 2, length=64), "shards")
        return shards, folder

    shards, folder = written(ROWS)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    ids = brute.encode(path, [t for _, t in rows], 2)
    for (doc_id, _), own in zip(rows, ids):
        want.append((doc_id, start, len(own), brute.crc(own)))
        start += len(own)
    got = token_files.read_token_files(shards, folder).drop("shard").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    flat = []
    for shard in shards.orderBy("shard").collect():
        opened = token_files.TokenFile(folder, shard["name"])
        for n in range(opened.sequences):
            found, mask = opened.sequence(n)
            assert len(found) == len(mask) == 64 and not found.flags.owndata and not mask.flags.owndata
            flat.append(found[mask.astype(bool)])
        with pytest.raises(IndexError):
            opened.sequence(opened.sequences)
    assert np.concatenate(flat).tolist() == [i for own in ids for i in own]
    shards, folder = written([])
    assert token_files.read_token_files(shards, folder).count() == 0


def test_masks_take_next_to_no_room(spark, tmp_path):
    """Ids of 16 bits are nearly all of a file; a mask of a byte each made it half as large again."""
    path = queries.tokenizer_file("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "word, " * 50_000) for i in range(4)], "doc_id long, text string").coalesce(1)
    (shard,) = token_files.write_token_files(docs, str(tmp_path), path, "leading", 2).coalesce(1).collect()
    assert (tmp_path / f"{shard['name']}.tokens.arrow").stat().st_size < 2.1 * shard["n_tokens"]


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "leading")])
def test_pieces_of_letters_need_none_of_the_patterns(name, cut):
    plain, encoder = Tokenizer.from_file(queries.tokenizer_file(name)), tokens.PieceEncoder(queries.tokenizer_file(name), cut)
    assert encoder.pieces("Reties$$$ of|a-b") == (["Reties", "$$$", "of", "|a-b"] if cut == "bare" else ["Reties", "$$$", " of", "|a-b"])
    space = " " if cut == "leading" else ""
    pieces = [space + w for w in ("Hello", "étionanen", "ÑRRIE", "ǅȺɏ", "a", "x" * 300)]
    ids, sizes = encoder._plain_ids(pieces)
    each = [plain.encode(p, add_special_tokens=False).ids for p in pieces]
    assert ids.tolist() == sum(each, []) and sizes.tolist() == [len(x) for x in each]
    seen = []
    encoder._ids = lambda some: seen.extend(some) or tokens.PieceEncoder._ids(encoder, some)
    text = "Hello étionanen, ÑRRIE$$$ don't 42"
    assert encoder.encode([f" {text}"])[0].tolist() == plain.encode(f" {text}", add_special_tokens=False).ids
    assert not [p for p in seen if p.strip().isalpha()]
