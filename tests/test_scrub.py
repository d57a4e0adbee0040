"""Read cleaning from files, against a plain version that goes through the lines."""

import random

from spanweave.jobs import scrub


def test_from_files_to_pieces(spark, tmp_path):
    rng = random.Random(6)
    reads = {f"r{k}": "".join(rng.choice("ACGT") for _ in range(rng.randint(700, 5000))) for k in range(9)}
    names = list(reads)

    def hit(q, qlen, t):
        size = rng.choice((300, 499, 500, 640, 900))
        s, e = rng.randrange(0, 3000), rng.randrange(0, max(1, len(reads[t]) - size))
        if q in reads:
            s = rng.randrange(0, max(1, qlen - size))
        return [q, qlen, s, s + size, rng.choice("+-"), t, len(reads[t]), e, min(len(reads[t]), e + size + rng.randrange(5)), size, size, 60]

    anchors = [hit(f"a{rng.randrange(12)}", 4000, rng.choice(names[:8])) for _ in range(60)]
    overlaps = []
    for _ in range(150):
        q, t = rng.choice(names), rng.choice(names)
        overlaps.append(hit(q, len(reads[q]), t))
    for name, rows in (("a.paf", anchors), ("o.paf", overlaps)):
        (tmp_path / name).write_text("\n".join("\t".join(map(str, r)) for r in rows))
    (tmp_path / "reads.fastq").write_text("".join(f"@{n} more\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads.items()))

    by_anchor, by_read = {}, {}
    for q, _, s, e, _, t, _, ts, te, *_ in anchors:
        if e - s >= 500:
            by_anchor.setdefault(t, {}).setdefault(q, (ts, te))
    for q, _, s, e, way, t, _, ts, te, *_ in overlaps:
        if q != t and e - s >= 500 and q in by_anchor and t in by_anchor:
            for own, other, lo, hi in ((q, t, s, e), (t, q, ts, te)):
                if (known := by_read.setdefault(own, {}).get(other)) is None:
                    by_read[own][other] = (lo, hi, way)
                elif way == known[2] and (abs(known[0] - hi) < 500 or abs(lo - known[1]) < 500):
                    by_read[own][other] = (min(lo, known[0]), max(hi, known[1]), way)
    want = set()
    for read in by_anchor:
        parts = []
        for s, e in sorted([*by_anchor[read].values(), *(x[:2] for x in by_read.get(read, {}).values())]):
            if parts and s <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], e)
            else:
                parts.append([s, e])
        for k, (s, e) in enumerate(parts):
            s, e = max(s, 200), min(e, len(reads[read]) - 200)
            if s <= e:
                want.add((f"{read}_{k}", reads[read][s : e + 1]))
    scrub.scrub_files(spark, str(tmp_path / "a.paf"), str(tmp_path / "o.paf"), str(tmp_path / "reads.fastq"), str(tmp_path / "out"))
    text = "\n".join(p.read_text().strip() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size)
    got = {(r.split("\n")[0], "".join(r.split("\n")[1:])) for r in text.lstrip(">").split("\n>")}
    assert got == want and len(want) > 8
    assert all(len(line) <= 60 for line in text.split("\n"))
    # no alignments, no pieces
    nothing = scrub.records.parse_paf(spark.createDataFrame([], "value string"))
    assert scrub.covered_ranges(nothing, nothing).count() == 0
