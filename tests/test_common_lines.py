from crosscut.operators import patch_rules
from crosscut.plans.derived import PALETTE


def _lines(spark):
    texts = ["@@ -1,1 +1,1 @@", *["+" + t for t in PALETTE if t is not None], "+let counter = 0", "+counter = counter + 1", "+let r = 1", "  counter.push(1)", "+other = 2", "-eval(old)", "+++ b/f.ts", "+x.counter = 3", "+let größe = 1", "+größe = 2"]
    rows = [(k, f"src/f{k}.{'test.ts' if k == 2 else 'ts'}", i, t) for k in range(3) for i, t in enumerate(texts[k:] + texts[: 9 * k])]
    return spark.createDataFrame(rows, "file_key long, filename string, idx int, raw string"), texts


def test_texts_are_read_once_for_all_lines(spark):
    lines, texts = _lines(spark)
    assert sorted(r.text for r in patch_rules._common(lines).collect()) == sorted(set(texts))


def test_common_and_rare_texts_agree(spark, monkeypatch):
    lines, _ = _lines(spark)
    shared = sorted(map(str, patch_rules.analyze_lines(lines, None).collect()))
    monkeypatch.setattr(patch_rules, "COMMON_BYTES", -1)
    assert patch_rules._common(lines).count() == 0
    assert sorted(map(str, patch_rules.analyze_lines(lines, None).collect())) == shared
    # a rule alone goes the other way
    kinds = patch_rules.RULE_IDS
    assert sorted(map(str, patch_rules.analyze_lines(lines, None, kinds).collect())) == shared
    assert any("GLOBAL_MUTATION" in r for r in shared)
