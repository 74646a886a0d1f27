import io
import json
import tarfile
import zipfile

from tarkash.sources import text


def put(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return {tuple(r[c] for c in (columns or df.columns)) for r in df.collect()}


def test_pairs(spark, tmp_path):
    p = put(tmp_path, "p.tsv", "Kem\tકેમ\t3\nkem\tકમ\nx\tક\nkem\tabc\nab\tક\tn\nab\tક\t1e99\n\n")
    assert rows(text.pairs(spark, p)) == {("kem", "કેમ", 3), ("kem", "કમ", 1), ("ab", "ક", 1)}
    assert rows(text.short_pairs(spark, p), "roman") == {("kem",)}


def test_archives(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/train.jsonl", '{"native word":"ક","english word":"ka"}\n{"word":"ક","roman":"KA"}\n{"x":"kha","y":"ખ"}\n{bad\n')
        f.writestr("d/.hidden.json", '{"word":"ગ","roman":"ga"}\n')
        f.writestr("notes.txt", "x")
    assert rows(text.zipped_pairs(spark, str(z))) == {("ka", "ક", 2), ("kha", "ખ", 1)}
    t = tmp_path / "a.tar"
    with tarfile.open(t, "w") as f:
        for name, body in (("l/train.tsv", "ક\tka\t2\nખ\tkha\tx\n"), ("l/dev.tsv", "ક\tka\t3\n"), ("l/other.txt", "ગ\tga\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            f.addfile(info, io.BytesIO(body.encode()))
    assert rows(text.tarred_pairs(spark, str(t), r"\.tsv$")) == {("ka", "ક", 5), ("kha", "ખ", 1)}
    assert rows(text.tarred_natives(spark, str(t), r"\.tsv$")) == {("ક",), ("ખ",)}
    g = tmp_path / "g.zip"
    with zipfile.ZipFile(g, "w") as f:
        f.writestr("a.csv", "કખ,x\n".encode("utf-16"))
        f.writestr("b.csv", "ગઘ;ક")
    assert rows(text.glossary(spark, str(g))) == {("કખ",), ("ગઘ",)}


def test_counts_and_words(spark, tmp_path):
    assert rows(text.counts(spark, put(tmp_path, "c", "3\tકખ\nકખ\t5\nકખ\tx\n1\t2\t3\n"))) == {("કખ", 5)}
    assert rows(text.trailing_counts(spark, put(tmp_path, "t", "કખ x 4\nકખ 9\nabc 3\nકખ\n\n"))) == {("કખ", 9)}
    assert rows(text.word_set(spark, put(tmp_path, "w", "#ક\nકખ x\n\nabc\n"))) == {("કખ",)}
    assert rows(text.wiki_words(spark, put(tmp_path, "k", "કખ (x)\n.ગઘ,\n"))) == {("કખ",), ("ગઘ",)}
    assert rows(text.hunspell(spark, put(tmp_path, "h", "3\nકખ/AB\n#ગ\nઘ\n"))) == {("કખ",), ("ઘ",)}
    assert [tuple(r) for r in text.corpus_counts(spark, put(tmp_path, "r", "કખ ગઘ કખ ક\n"), 1).collect()] == [("કખ", 2)]
    assert rows(text.frequent_natives(spark, put(tmp_path, "f", "20\tકખ\n19\tગઘ\n"))) == {("કખ",)}
    a, b = text.counts(spark, put(tmp_path, "m1", "3\tક\n")), text.counts(spark, put(tmp_path, "m2", "4\tક\n"))
    assert rows(text.merged_counts(a, b)) == {("ક", 4)}
    dump = put(tmp_path, "d", "a\tકખ\t1\nગઘ\tx\nચછ-જઝ\n")
    assert rows(text.natives(spark, dump, "dump")) == {("કખ",), ("ગઘ",), ("ચછ-જઝ",)}
    assert rows(text.natives(spark, dump, "csv")) == {("કખ",), ("ગઘ",), ("ચછ",), ("જઝ",)}


def test_dictionaries(spark, tmp_path):
    p = put(tmp_path, "d.yaml", "---\nname: x\n...\n# c\nકેમ\tKem\t7\nકમ\tkam\nકમ\nabc\tx\n")
    assert rows(text.dictionary(spark, p)) == {("કેમ", "kem", 7), ("કમ", "kam", 100)}
    assert rows(text.probes(spark, put(tmp_path, "p", "Ka\tક\t0\t-1.5\nka\tખ\t3\t0\n"))) == {("ka", "ક", 0, -1.5)}
    assert rows(text.quality_words(spark, put(tmp_path, "q.json", '["કખ", "ાક", "k", "કખ"]'))) == {("કખ",)}


def test_emoji(spark, tmp_path):
    assert rows(text.emoji_dictionary(spark, put(tmp_path, "e", "a b 1\n...\n😀 Hasavu 5\n😀 has 2000\n# x y 1\n😀 1x 3\n"))) == {("hasavu", "😀", 1000), ("has", "😀", 2000)}
    assert rows(text.emoji_extra(spark, put(tmp_path, "x", "#c\nHas\t😀\nhu\t😀\t7\n1\t😀\n"))) == {("has", "😀", 1000), ("hu", "😀", 7)}
    assert rows(text.emoji_keywords(spark, put(tmp_path, "k", json.dumps({"😀": [":big_grin:"]})))) == {("biggrin", "😀"), ("big", "😀"), ("grin", "😀")}
    nested = {"annotations": {"annotations": {"😀": {"default": ["face"], "tts": ["grin"]}, "😃": {"tts": "smile"}}}}
    assert rows(text.emoji_annotations(spark, put(tmp_path, "a", json.dumps(nested)))) == {("face", "😀"), ("grin", "😀"), ("smile", "😃")}


def test_evidence_gold_and_reports(spark, tmp_path):
    got = text.evidence(spark, put(tmp_path, "u", "ક\t5\nખ\tx\n"), put(tmp_path, "s", '{"ક": 2, "ગ": 3}'), put(tmp_path, "a", '{"words": ["ગ", "ઘ"], "floor": 50}'))
    assert rows(got, "native", "unigram", "stem", "attested") == {("ક", 5, 2, False), ("ગ", 0, 3, True), ("ઘ", 0, 0, True)}
    assert rows(text.gold(spark, put(tmp_path, "g", '{"roman":"Ka","native":"ક"}\n{"input":"kha","gold":"ખ"}\n{"x":1}\n'))) == {("ka", "ક"), ("kha", "ખ")}
    assert rows(text.prefix_index(spark, put(tmp_path, "i", "ka\tx\ty\nka\tz\n\tq\nnone\n"))) == {("ka", "x\ty"), ("ka", "z")}
    (tmp_path / "r" / "s").mkdir(parents=True)
    put(tmp_path / "r" / "s", "verification-1.json", '{"passed": true}')
    put(tmp_path / "r", "other.json", "{}")
    assert rows(text.reports(spark, str(tmp_path / "r")), "report") == {('{"passed": true}',)}
