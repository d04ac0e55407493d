import random

import numpy as np
from forumlens.llm import sentencepiece_codec as sp
from pyspark.sql import functions as F

PIECES = ["▁", "▁the", "t", "h", "e", "th", "he", "▁t", "a", "ab", "abc", "bc", "c", "b", "▁▁", "▁▁▁", "é", "éa", "▁é", "x▁"]


def toy(seed):
    rng = random.Random(seed)
    own = [p for p in PIECES if p != "x▁"]
    pieces = {p: 259 + i for i, p in enumerate(own)}
    scores = np.array([0.0] * 259 + [-rng.uniform(1, 9) for _ in own])
    texts = [b""] * 3 + [bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in own]
    return sp.Codec(sp.Vocabulary(pieces, scores, list(range(3, 259)), texts))


def best_score(codec, marked):
    """Plain Viterbi over characters."""
    best = [0.0] + [-np.inf] * len(marked)
    for i in range(len(marked)):
        for j in range(i + 1, len(marked) + 1):
            number = codec.vocabulary.pieces.get(marked[i:j])
            if number is not None:
                best[j] = max(best[j], best[i] + codec.scores[number])
        if marked[i] not in codec.vocabulary.pieces:
            best[i + 1] = max(best[i + 1], best[i] - codec.longest_gap * len(marked[i].encode()))
    return best[-1]


def path_score(codec, ids):
    return sum(codec.scores[i] if i >= 259 else -codec.longest_gap for i in ids)


def test_viterbi_finds_the_best_path():
    rng = random.Random(0)
    for seed in range(5):
        codec = toy(seed)
        texts = ["".join(rng.choice("thebac é☃") for _ in range(rng.randrange(1, 25))) for _ in range(200)]
        for text, ids in zip(texts, codec.encode(texts)):
            assert codec.decode(ids) == text
            assert np.isclose(path_score(codec, ids), best_score(codec, "▁" + text.replace(" ", "▁")))


def test_agrees_with_the_library_on_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    rng = random.Random(4)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=kind)
    for i in range(256):
        model.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    scores = [0.0] * 259
    for p in [p for p in PIECES if p != "x▁"]:
        scores.append(-rng.uniform(1, 9))
        model.pieces.add(piece=p, score=scores[-1], type=1)
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = toy(0)
    codec.scores = np.array([lib.get_score(i) for i in range(lib.get_piece_size())])
    texts = ["".join(rng.choice("thebac é") for _ in range(rng.randrange(1, 20))) for _ in range(200)] + ["the☃cab"]
    for text, ids in zip(texts, codec.encode(texts)):
        want = lib.encode(text)
        assert np.isclose(path_score(codec, ids), path_score(codec, want)), text
        assert ids.tolist() == want


def test_trie_finds_exactly_its_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 6))): i for i in range(300)}
    trie = sp.DoubleArray(keys)
    for _ in range(3000):
        key = bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 7)))
        assert trie.find(key) == keys.get(key, -1)


def test_round_trip_in_spark(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b\n\tc▁d ☃ 中文 𝔘"), (5, "word " * 20000), (5, "▁"), (None, "x" * 5000)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>")
    got = sp.encoded(df).withColumn("back", sp.decode(F.col("ids"))).collect()
    assert len(got) == len(rows)
    assert all(r.text == r.back and r.round_trip for r in got)
    assert sorted((r.text is None, r.ids is None) for r in got) == [(False, False)] * 6 + [(True, True)]
    assert sp.encoded(df.limit(0)).count() == 0


def test_long_segments_take_the_same_paths():
    rng = random.Random(7)
    for seed in range(3):
        codec = toy(seed)
        short = ["".join(rng.choice("thebac é☃") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
        for segment in {sp._marked(k) for t in short for k in codec._segments(t) if k != sp.MARKER}:
            ids, per = codec._viterbi([segment])
            assert per.tolist() == [len(ids)] and ids.tolist() == codec._viterbi_long(segment).tolist()
        long = "".join(rng.choice("thebacé☃") for _ in range(3 * sp.LONG))
        found = codec.encode([long])[0].tolist()
        assert max(len(s) for s in codec._segments(long)) > sp.LONG
        assert np.isclose(path_score(codec, found), best_score(codec, "▁" + long)) or np.isclose(path_score(codec, found), best_score(codec, long))
        assert codec.decode(found) == long
