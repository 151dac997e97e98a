"""Selection, packs, quality checks, consent and export, manifests, configuration and the command line."""

import hashlib
import json
import posixpath
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from korpuslab import cli
from korpuslab.errors import ConfigError, FreezeError
from korpuslab.operators import governance, manifests, pack, qc, selection, terms
from korpuslab.sources.config import check, load_config
from korpuslab.sources import files
from korpuslab.sources.files import checksums, file_checksum, read_tsv, write_json, write_tsv


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "clips").mkdir(parents=True)
    rows = ["client_id\tpath\tsentence\tlocale\tsplit"]
    for i in range(12):
        name = f"clip-{i}.x.wav"
        rows.append(f'client {i % 3} \t{name}\t"say ""{i}"""\t{"tr" if i < 10 else "de"}\t{"train" if i % 2 else ""}')
        if i != 4:
            (root / ("clips" if i % 2 else ".") / name).write_bytes(f"audio {i}".encode())
    rows += ["\t\tno client\ttr\t", "client 9\t"]
    (root / "validated.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    return root


def test_selection(spark, corpus):
    pick = lambda **more: selection.select_clips(spark, corpus, **({"limit": 5, "seed": 1, "source_version": "v1"} | more))
    one = pick()
    assert one == pick() and len(one.selected_clips) == 5 and one.replacement_policy == {"missing_source": "excluded", "missing_count": 1}
    everything = pick(limit=99)
    assert len(everything.selected_clips) == 9 and {c["clip_id"] for c in everything.selected_clips} == {f"clip-{i}.x" for i in range(10) if i != 4}
    assert sum(everything.speaker_distribution.values()) == 9 and all(k.startswith("spk-") for k in everything.speaker_distribution)
    assert [c["clip_id"] for c in pick(seed=2, limit=99).selected_clips] != [c["clip_id"] for c in everything.selected_clips]
    assert {c["path"].startswith("clips/") for c in everything.selected_clips} == {True, False}
    assert 'say "0"' in {c["sentence"] for c in everything.selected_clips}
    assert "client" not in json.dumps(everything.to_dict()).replace("client_id", "")
    selection.verify_selection(spark, corpus, everything)
    (corpus / everything.selected_clips[0]["path"]).write_bytes(b"other")
    with pytest.raises(ValueError, match="changed"):
        selection.verify_selection(spark, corpus, everything)
    with (corpus / "validated.tsv").open("a") as f:
        f.write("c\tnew.wav\tx\ttr\t\n")
    with pytest.raises(ValueError, match="table changed"):
        selection.verify_selection(spark, corpus, everything)


def test_selection_refuses(spark, corpus, tmp_path):
    for bad in ({"limit": 0}, {"source_version": ""}):
        with pytest.raises(ValueError):
            selection.select_clips(spark, corpus, **({"limit": 1, "seed": 1, "source_version": "v"} | bad))
    with pytest.raises(FileNotFoundError):
        selection.select_clips(spark, tmp_path, limit=1, seed=1, source_version="v")
    (corpus / "train.tsv").write_text("client_id\tpath\nc\t../outside.wav\n")
    with pytest.raises(ValueError, match="leaves"):
        selection.select_clips(spark, corpus, limit=1, seed=1, source_version="v", split="train")
    (corpus / "train.tsv").write_text("client_id\tpath\nc\tx/../clip-0.x.wav\n")
    assert selection.select_clips(spark, corpus, limit=1, seed=1, source_version="v", split="train").selected_clips[0]["path"] == "clip-0.x.wav"


def write_pack(root, sentences=None, lexicon=None):
    root.mkdir(exist_ok=True)
    (root / "terms.tsv").write_text("term_id\tterm_family\tcanonical_term\taliases\tcategory\nt1\tf1\tPyTorch\tpy torch\tterm\nt2\tf2\tCUDA\t\tterm\n")
    (root / "operational_lexicon.tsv").write_text(lexicon or "canonical_term\taliases\tsource_id\tsource_uri\tfrozen_before_authoring\nPyTorch\tx\ts\tu\ttrue\n")
    (root / "sentences.tsv").write_text(sentences or "sentence_id\tsplit\tterm_id\tterm_family\ttext\treference\tsuffix\tnegative_control\tmore\ns1\ttech_dev\tt1\tf1\ta\ta\tile\tfalse\tm\ns2\ttech_test_frozen\tt2\tf2\tb\tb\t\tno\tm\ns3\ttech_test_frozen\t\t\tc\tc\t\tYES\tm\ns4\ttech_dev\tunknown\tf9\td\td\t\t\tm\n")
    (root / "spontaneous_prompts.tsv").write_text("prompt_id\tsplit\tprompt\np1\ttech_dev\tsay\n")
    return root


def test_pack(spark, tmp_path):
    got = pack.load_pack(spark, write_pack(tmp_path / "p"))
    assert got.families == {"tech_dev": {"f1", "f9"}, "tech_test_frozen": {"f2"}}
    assert [r["negative_control"] for r in got.sentences.orderBy("sentence_id").collect()] == [False, False, True, False]
    assert "more" in got.sentences.columns and got.lexicon.first()["frozen_before_authoring"] is True


HEAD = "sentence_id\tsplit\tterm_id\tterm_family\ttext\treference\tsuffix\tnegative_control\n"
LEX = "canonical_term\taliases\tsource_id\tsource_uri\tfrozen_before_authoring\n"


@pytest.mark.parametrize(("what", "text", "message"), [
    ("sentences", HEAD + "s\tother\t\t\ta\ta\t\t\n", "unknown-split"), ("sentences", HEAD + "s\ttech_dev\tt1\tf2\ta\ta\t\t\n", "family-mismatch"), ("sentences", HEAD + "s\ttech_dev\t\tf\ta\ta\t\t\nz\ttech_test_frozen\t\tf\ta\ta\t\t\n", "family-leak"),
    ("sentences", HEAD, "no rows"), ("lexicon", LEX + "Nope\tx\ts\tu\ttrue\n", "unknown-term"), ("lexicon", LEX + "CUDA\tx\t\tu\ttrue\n", "no-receipt"), ("lexicon", LEX + "CUDA\tx\ts\tu\tfalse\n", "not-frozen"),
])
def test_pack_refuses(spark, tmp_path, what, text, message):
    with pytest.raises(ValueError, match=message):
        pack.load_pack(spark, write_pack(tmp_path / "p", **{what: text}))


def test_listing_and_checksums_of_a_deep_folder(spark, tmp_path, monkeypatch):
    """Every level, odd names, links, empty folders; and the same by URI."""
    root = tmp_path / "r"
    names = ["a.bin", "_u/b", ".dot/c", ".d", "x/y/z/w/deep file.txt", "x/ü%20é.txt", "x/.h", "big"] + [f"many/{i:03d}" for i in range(120)]
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"%d" % i if name != "big" else bytes(range(256)) * 20_000)
    (root / "empty").mkdir()
    (root / "x" / "loop").symlink_to(root)
    (root / "link").symlink_to(root / "a.bin")
    want = {n: (root / n).stat().st_size for n in [*names, "link"]}
    for at in (root, f"file://{root}"):
        assert {r["path"]: r["size"] for r in files.listing(spark, at).collect()} == want
    sums = {r["path"]: r["checksum"] for r in checksums(spark, root).collect()}
    assert sums == {n: file_checksum(root / n) for n in want if not n.rsplit("/", 1)[-1].startswith(".")}
    assert files.selected_checksums(spark, f"file://{root}", ["big", "x/ü%20é.txt"]) == {n: sums[n] for n in ("big", "x/ü%20é.txt")}
    (tmp_path / "none").mkdir()
    assert files.listing(spark, tmp_path / "none").collect() == [] and checksums(spark, tmp_path / "none").count() == 0 and files.selected_checksums(spark, tmp_path / "none", []) == {}


def test_folders_by_uri(spark, tmp_path):
    root = write_pack(tmp_path / "p")
    uri = f"file://{root}"
    assert pack.load_pack(spark, uri).families == pack.load_pack(spark, root).families
    manifest = pack.freeze(spark, uri, content_version="1", stage="release")
    assert manifest == pack.freeze(spark, root, content_version="1", stage="release")
    pack.verify_frozen(spark, uri, manifest)


def test_freeze(spark, tmp_path):
    root = write_pack(tmp_path / "p")
    (root / ".hidden").write_text("x")
    (root / "_kept").mkdir()
    (root / "_kept" / "f").write_text("y")
    manifest = pack.freeze(spark, root, content_version="1", stage="release")
    assert set(manifest["files"]) == {"terms.tsv", "operational_lexicon.tsv", "sentences.tsv", "spontaneous_prompts.tsv", "_kept/f"}
    assert manifest["files"]["terms.tsv"] == file_checksum(root / "terms.tsv") and manifest["content_id"].startswith("content-")
    pack.verify_frozen(spark, root, manifest)
    (root / "terms.tsv").write_text("changed")
    with pytest.raises(FreezeError):
        pack.verify_frozen(spark, root, manifest)
    with pytest.raises(ValueError):
        pack.freeze(spark, root, content_version="1", stage="draft")
    assert checksums(spark, str(root)).count() == 5


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 'say "x"\nnext'), ("", None)], "a string, b string")
    write_tsv(df.coalesce(1), str(tmp_path / "t"))
    back = read_tsv(spark, str(tmp_path / "t"))
    assert back.first()["b"] == 'say "x"\nnext' and back.count() == 2


def test_terms(spark):
    schema = "mention_id string, term_id string, surface string, accepted_aliases array<string>, suffix string, term_family string"
    want = spark.createDataFrame([("m1", "t1", "PyTorch", ["py torch"], "ile", "f"), ("m2", "t2", "CUDA", [], "da", "f"), ("m3", "t3", "API", None, None, "g")], schema)
    got = spark.createDataFrame([(1, "m1", "t1", "PY TORCH", "ile"), (2, "m2", "t9", "x", "da"), (3, "m2", "t2", "cuda,", "ı"), (4, "extra", "t", "s", "")], "k int, mention_id string, term_id string, surface string, suffix string")
    row = terms.term_metrics(want, got, order=F.col("k")).first()
    assert (row["total"], row["surface_correct"], row["canonical_correct"], row["suffix_preserved"], row["identity_damage"]) == (3, 2, 2, 1, 1)
    assert terms.term_metrics(want.limit(0), got).first()["surface_accuracy"] == 0.0


def test_lexicon_match(spark):
    lexicon = spark.createDataFrame([("PyTorch", "pytorch"), ("CUDA", "kuda"), ("Kubernetes", "kube"), ("Cube", "kubo")], "canonical_term string, form string")
    df = spark.createDataFrame([(1, "Bugün pytorc'ta ve kuda! kubx nothing")], "key int, text string")
    rows = {r["token"]: (r["canonical_term"], r["distance"], r["abstained"]) for r in terms.match_lexicon(df, "text", lexicon, 1).collect()}
    assert rows == {"pytorc'ta": ("PyTorch", 1, False), "kuda": ("CUDA", 0, False), "kubx": (None, 1, True)}


def test_suffix_chains():
    """Chains a speaker would write, and some that break harmony, hardening or buffers."""
    from korpuslab.functions.suffixes import chains

    good = {("u", "hard"): ["tan", "un", "lardan", "umuz", "larımızdan", "ta", "tur"], ("i", "vowel"): ["yi", "m", "si", "sinden", "nin", "yle", "ler", "lerinde"], ("ü", "soft"): ["ü", "de", "üm", "lerin", "ün"], ("ı", "soft"): ["ın", "larına", "dan", "ımızla", "ca", "dır"]}
    bad = {("u", "hard"): ["dan", "ten", "ın", "yu", ""], ("i", "vowel"): ["i", "im", "ya", "in", "lar"], ("ü", "soft"): ["da", "te", "ın", "yi"], ("ı", "soft"): ["in", "ten", "sı", "larlar"]}
    assert all(s in chains(*kind) for kind, some in good.items() for s in some)
    assert not any(s in chains(*kind) for kind, some in bad.items() for s in some)


def test_inflected_match(spark):
    lexicon = spark.createDataFrame([("PyTorch", "pytorch"), ("CUDA", "cuda"), ("Kubernetes", "kubernetes"), ("GPT", "gpt"), ("Kubeflow", "kubeflow"), ("Kubeflov", "kubeflov"), ("Model", "model"), ("Hugging Face", "hugging face")], "canonical_term string, form string")
    df = spark.createDataFrame([(1, "pytorchtan PyTorch'un bytorchta"), (2, "kudayla cudalarımızdan"), (3, "gptden gpt'yle kubeflox modelten"), (4, None), (5, ""), (6, "modelden kübernetesin masadan")], "key int, text string")
    got = {(r["key"], r["token"]): (r["canonical_term"], r["stem"], r["suffix"], r["how"], r["abstained"]) for r in terms.match_inflected(df, "text", lexicon).collect()}
    assert got[1, "pytorchtan"] == ("PyTorch", "pytorch", "tan", "exact", False) and got[1, "pytorch'un"] == ("PyTorch", "pytorch", "un", "exact", False)
    assert got[1, "bytorchta"] == ("PyTorch", "bytorch", "ta", "near", False)
    assert got[2, "kudayla"][:4] == ("CUDA", "kuda", "yla", "near") and got[2, "cudalarımızdan"][:4] == ("CUDA", "cuda", "larımızdan", "exact")
    assert got[3, "gptden"][0] == "GPT" and got[3, "gpt'yle"][0] == "GPT" and got[3, "kubeflox"][0] is None and got[3, "kubeflox"][4]
    assert (3, "modelten") not in got or got[3, "modelten"][3] != "exact"
    assert got[6, "modelden"][:3] == ("Model", "model", "den") and got[6, "kübernetesin"][0] == "Kubernetes" and (6, "masadan") not in got
    sounds = {r["token"]: (r["canonical_term"], r["how"]) for r in terms.match_inflected(spark.createDataFrame([(1, "kubarnatısta kuperneytes")], "key int, text string"), "text", lexicon).collect()}
    assert sounds["kubarnatısta"] == ("Kubernetes", "sound")
    assert terms.match_inflected(df, "text", lexicon.limit(0)).count() == 0


def test_quality_checks(spark):
    rows = [("Merhaba dünya", "merhaba  DÜNYA", True, "active", False, False, False, False, False), ("a", "b", True, "active", True, True, False, False, False), ("a", "b", False, "withdrawn", True, True, True, True, True), ("a", "b", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "r string, o string, au boolean, c string, v boolean, cl boolean, cp boolean, co boolean, ar boolean")
    got = [(q["status"], q["reasons"], q["pronunciation_variant"]) for (q,) in df.select(qc.qc_read(*map(F.col, df.columns))).collect()]
    assert got[0] == ("passed", [], False) and got[1] == ("passed", [], True)
    assert got[2] == ("failed", ["missing_audio", "missing_consent", "clipping", "corruption", "artificial_spelling", "content_mismatch"], False)
    assert got[3] == ("failed", ["missing_audio", "missing_consent", "content_mismatch"], False)
    two = spark.createDataFrame([(" ", True, "active"), ("x", True, "active")], "m string, a boolean, c string").select(qc.qc_spontaneous(F.col("m"), F.col("a"), F.col("c")).alias("q")).collect()
    assert [r["q"]["reasons"] for r in two] == [["missing_manual_reference"], []]


def test_eligibility(spark, tmp_path):
    df = spark.createDataFrame([(1, "spk-a", "active", "research"), (2, "spk-b", "withdrawn", "research")], "place int, speaker_id string, consent_status string, usage_scope string")
    manifest = governance.registry_manifest(df, "place")
    records = manifest["records"]
    assert records["spk-a"]["eligibility"] == "eligible" and records["spk-b"]["eligibility"] == "ineligible" and records["spk-a"]["qc_state"] == "pending"
    for row, message in (((3, "x", "active", "r"), "opaque"), ((3, "spk-a", "active", "r"), "repeated"), ((3, "spk-c", "maybe", "r"), "consent"), ((3, "spk-c", "active", ""), "scope")):
        with pytest.raises(ValueError, match=message):
            governance.registry_manifest(df.union(spark.createDataFrame([row], df.schema)), "place")
    after = governance.registry_manifest(governance.withdraw(df.withColumn("eligibility", F.lit("eligible")), "spk-a"), "place", manifest["manifest_version"] + 1)
    assert after["records"]["spk-a"]["consent_status"] == "withdrawn" and after["manifest_version"] == 2 and governance.manifest_checksum(after) != governance.manifest_checksum(manifest)


def test_quarantine(spark, tmp_path):
    manifest = {"manifest_version": 1, "records": {"spk-a": {}, "spk-b": {}}}
    store = governance.Quarantine(spark, str(tmp_path))
    for name in ("spk-a", "spk-b"):
        (tmp_path / f"participants/{name}").mkdir(parents=True)
        (tmp_path / f"participants/{name}/f").write_text("x")
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "speaker_id string")
    for bad in ("spk-zz", "../spk-a", "..", "a\\b"):
        with pytest.raises(ValueError):
            store.hold(ask(bad), manifest, 1000.0)
    assert (tmp_path / "participants/spk-a/f").exists()
    [held] = store.hold(ask("spk-a"), manifest, 1000.0).collect()
    assert held["token"] == hashlib.sha256(f"spk-a|1000.0|{governance.manifest_checksum(manifest)}".encode()).hexdigest()[:20]
    assert (tmp_path / f"quarantine/{held['token']}/f").exists() and not (tmp_path / "participants/spk-a").exists() and (tmp_path / "participants/spk-b/f").exists()
    assert (held["quarantine_until"], held["backup_expiry"], held["due"]) == (1000.0 + 604800, 1000.0 + 2592000, False)
    store.hold(ask("spk-b"), manifest, 2000.0)
    assert store.sweep(held["quarantine_until"] - 1) == 0 and store.sweep(held["quarantine_until"]) == 1 and store.sweep(held["quarantine_until"]) == 0
    assert not (tmp_path / f"quarantine/{held['token']}").exists()
    assert {r["speaker_id"]: r["deleted_at"] for r in governance.quarantine_state(store.events(), 0.0).collect()} == {"spk-a": held["quarantine_until"], "spk-b": None}


def test_export(spark):
    good = spark.createDataFrame([("clips/a", "x")], "audio_path string, text string")
    assert governance.public_export(good) is good
    for bad in ("client_id string", "Address string"):
        with pytest.raises(ValueError):
            governance.public_export(spark.createDataFrame([("v",)], bad))
    for path in ("/data/x", "C:\\x"):
        with pytest.raises(ValueError, match="absolute"):
            governance.public_export(spark.createDataFrame([(path,)], "AudioPath string"))


def test_manifests():
    given = dict(source_fingerprints={"b": "2", "a": "1"}, benchmark_content_id="c", model_repository="m", model_revision="r", dependency_lock_hash="d", decoding_settings={"temperature": 0, "é": [1, (2,)], "at": Path("x") / "y"}, seed=42, device_policy="cpu")
    again = dict(reversed(given.items())) | {"source_fingerprints": {"a": "1", "b": "2"}, "decoding_settings": {"é": (1, [2]), "at": "x/y", "temperature": 0}}
    one = manifests.identity("transcription", given)
    assert one == manifests.identity("transcription", again) and one.startswith("tr-") and len(one) == 27 and one != manifests.identity("transcription", given | {"seed": 43})
    want = json.dumps({**given, "decoding_settings": {"temperature": 0, "é": [1, [2]], "at": "x/y"}}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert one == "tr-" + hashlib.sha256(want.encode()).hexdigest()[:24]
    full = manifests.manifest("transcription", given, "now")
    assert full["transcription_run_id"] == one and full["created_at"] == "now" and full["seed"] == 42 and manifests.manifest("transcription", given, "now", "mine")["transcription_run_id"] == "mine"
    with pytest.raises(ValueError, match="sed"):
        manifests.identity("transcription", {("sed" if k == "seed" else k): v for k, v in given.items()})
    evaluation = dict.fromkeys(manifests.KINDS["evaluation"].fields, "x")
    assert manifests.manifest("evaluation", evaluation, "now")["evaluation_id"].startswith("ev-")


def test_lexicon_finds_what_is_near(spark):
    forms = spark.createDataFrame([("PyTorch", "pytorch"), ("Hugging Face", "hugging face"), ("CUDA", "cuda"), ("Cuda2", "cudb")], "canonical_term string, form string")
    rows = spark.createDataFrame([(1, "bytorch'ta eğitim"), (2, "bir hagging fase modeli"), (3, "cudc iyi"), (4, None), (5, "")], "key int, text string")
    got = {(r["key"], r["token"]): r for r in terms.match_lexicon(rows, "text", forms, 2, trace=True).collect()}
    first = got[1, "bytorch'ta"]
    assert (first["canonical_term"], first["distance"], first["place"], first["abstained"]) == ("PyTorch", 1, 0, False)
    assert [e["operation"] for e in first["edits"]] == ["substitute"] + ["equal"] * 6
    assert (got[2, "hagging fase"]["canonical_term"], got[2, "hagging fase"]["place"], got[2, "hagging fase"]["distance"]) == ("Hugging Face", 1, 2)
    assert got[3, "cudc"]["abstained"] and got[3, "cudc"]["canonical_term"] is None and set(got) == {(1, "bytorch'ta"), (2, "hagging fase"), (3, "cudc")}
    alike = spark.createDataFrame([("kuda",), ("cuda",), ("guta",), ("masa",)], "w string").select(terms.phonetic_key(F.col("w")).alias("k")).collect()
    assert alike[0]["k"] == alike[2]["k"] != alike[3]["k"]


def test_plain_paths(spark):
    paths = ["a/b.wav", "./a//b.wav", "a/../b.wav", "a/./b/../c.wav", "x/y/../../z", "../a/../b", "a/.."]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(selection.plain_path(F.col("p")).alias("q")).collect()
    assert [r["q"] or "." for r in got] == [posixpath.normpath(p) for p in paths]


CONFIG = {"seed": 1, "ledger_path": "x/ledger", "artifact_dir": "/abs", "engine": "e", "model_repository": "m", "model_revision": "r", "normalizer_version": "n"}


def test_config(tmp_path):
    got = check(CONFIG, tmp_path)
    assert got.ledger_path == (tmp_path / "x/ledger").resolve() and got.decoding == {} and got.source_root is None
    for bad in ({"seed": True}, {"seed": "1"}, {"engine": " "}, {"decoding": []}, {"artifact_dir": 3}, {"unknown": 1}):
        if bad == {"decoding": []}:
            bad = {"decoding": [1]}
        with pytest.raises(ConfigError):
            check(CONFIG | bad, tmp_path)
    with pytest.raises(ConfigError, match="missing"):
        check({k: v for k, v in CONFIG.items() if k != "engine"}, tmp_path)
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none.yaml")


def test_command_line(spark, corpus, tmp_path, capsys):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("\n".join(f"{k}: {v}" for k, v in CONFIG.items()))
    assert cli.main(["config", "validate", "--config", str(tmp_path / "c.yaml")]) == 0 and '"seed": 1' in capsys.readouterr().out
    (tmp_path / "c.yaml").write_text("a: [")
    assert cli.main(["config", "validate", "--config", str(tmp_path / "c.yaml")]) == 2 and "error" in capsys.readouterr().err
    out = tmp_path / "out.json"
    args = ["data", "select-clips", "--root", str(corpus), "--output", str(out), "--limit", "3", "--seed", "1", "--source-version", "v1"]
    assert cli.main(args) == 0 and len(json.loads(out.read_text())["selected_clips"]) == 3
    shutil.rmtree(corpus)
    assert cli.main(args) == 2
    write_json(out, {"b": "ü", "a": 1})
    assert out.read_text() == '{\n  "a": 1,\n  "b": "ü"\n}\n'
