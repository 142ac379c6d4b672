import random

from wachbuch.llm import scans, subjects

SENTENCES = [
    "Die Verteidigung hat angekündigt, weitere Beweismittel vorzulegen, insbesondere Lichtbilder aus dem fraglichen Zeitraum.", "Der Angeklagte befindet sich weiterhin in Untersuchungshaft und hat sich zu den Vorwürfen bislang nicht geäußert.",
    "Das Gericht hat das Hauptverfahren eröffnet und die Anklage unverändert zur Verhandlung zugelassen.", "Es drohen Haft- und Geldstrafen in beträchtlicher Höhe.",
]


def scanned(seed, n=60):
    """Texts with furniture, divisions and misreadings, and what was done to them."""
    rnd, docs, truth = random.Random(seed), [], set()
    slips = (("e", "c"), ("n", "u"), ("h", "b"), ("i", "1"), ("ü", "ii"))
    for d in range(n):
        lines, line = [], ""
        for page in (1, 2, 3):
            words = " ".join(rnd.choice(SENTENCES) for _ in range(6)).split()
            for w in words:
                core = w.strip(".,")
                shown = w
                if rnd.random() < 0.04 and len(core) > 5 and core.isalpha():
                    a, b = rnd.choice(slips)
                    if a in core[1:]:
                        at = core.index(a, 1)
                        shown = w.replace(core, core[:at] + b + core[at + 1 :])
                if len(line) + len(shown) > 66:
                    if len(core) > 9 and shown == w and core.isalpha() and rnd.random() < 0.7:
                        k = rnd.randrange(3, len(core) - 3)
                        lines.append(f"{line} {w[:k]}{rnd.choice('-¬')}".strip())
                        truth.add((d, len(lines), "hyphen", core))
                        line = w[k:]
                        continue
                    lines.append(line)
                    line = ""
                line = f"{line} {shown}".strip()
                if shown != w:
                    truth.add((d, len(lines) + 1, "ocr", core))
            lines.append(line)
            line = ""
            lines.append(f"Seite {page}")
            truth.add((d, len(lines), "page_no", ""))
            lines.append("Landgericht Bremen · Pressestelle")
            truth.add((d, len(lines), "header", ""))
        docs.append((d, "\n".join(lines), "k", 1))
    return docs, truth


def test_repair_of_scans(spark):
    docs, truth = scanned(7)
    df = spark.createDataFrame([*docs, (1000, None, "k", 1), (1001, "", "k", 1)], "court_doc_id long, text string, kind string, line_no int")
    got = {tuple(r) for r in scans.found(df).collect()}
    for kind, least in (("header", 0.98), ("page_no", 0.98), ("hyphen", 0.95), ("ocr", 0.8)):
        g, w = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(g & w) >= least * len(w) and len(g & w) >= 0.9 * len(g), (kind, len(g), len(w), len(g & w))
    whole = {r.court_doc_id: r.text for r in scans.repaired(df).collect()}
    assert whole[1000] is None and whole[1001] == "" and "Pressestelle" not in whole[0] and "Haft- und" in " ".join(filter(None, whole.values()))


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "court_doc_id long, text string")
    assert scans.found(df).count() == 0


def test_operations_give_back_the_printed_word():
    for a, b in (("nachdern", "nachdem"), ("ﬁnden", "finden"), ("ei.nes", "eines"), ("vveiter", "weiter"), ("dafiir", "dafür"), ("Zeugn", "Zeugen")):
        ops, out = scans.operations(a, b), ""
        for c, op in zip(a, ops, strict=True):
            out += scans.applied(c, op)
        assert out == b


TOPICS = {"sport": ["Der Torwart hielt den Ball von Nummer {n} fest.", "Die Mannschaft gewann mit {n} Toren.", "Der Trainer lobt die Abwehr."], "weather": ["In der Nacht gibt es Nebel.", "Der Wind erreicht {n} Kilometer.", "Ein Tief bringt Regen mit {n} Millimetern."], "law": ["Das Gericht vertagt den Prozess.", "Der Richter verhängt {n} Monate Haft.", "Die Anklage lautet auf Betrug."]}


def test_subjects_held_out(spark):
    rnd, docs, labels, want = random.Random(1), [], [], set()
    for k in range(400):
        mine = rnd.sample(sorted(TOPICS), rnd.choice((1, 1, 2)))
        ss = [rnd.choice(TOPICS[t]).format(n=rnd.randrange(90)) for t in mine for _ in range(6)] + ["Weitere Angaben folgen."]
        rnd.shuffle(ss)
        docs.append((k, " ".join(ss), "s"))
        (labels.extend((k, t) for t in mine) if k % 2 else want.update((k, t) for t in mine))
    docs += [(900, None, None), (901, " ", None), (902, "Weitere Angaben folgen.", None), (903, "Der Torwart hielt den Ball von Nummer 3 fest. F&uuml;r <b>Regen</b>", None)]
    labels += [(5000, "sport"), (1, "unknown"), (None, "law")]
    d, la, ar = spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(t,) for t in TOPICS], "subject string")
    got = {tuple(r) for r in subjects.found(d, la, ar).collect()}
    held = {x for x in got if x[0] < 400 and x[0] % 2 == 0}
    assert len(held & want) >= 0.95 * len(want) and len(held & want) >= 0.95 * len(held)
    assert not [x for x in got if x[0] in (900, 901, 902)]
    assert subjects.found(d.where("false"), la.where("false"), ar).count() == 0


def test_sentences_keep_ordinals_together():
    assert len(subjects.sentences("Er kam zum 3. Mal. Dann ging er.\n\nEnde der Mitteilung")) == 3
    assert subjects.sentences(None) == [] and subjects.clean("f&uuml;r fÃ¼r f​ür") == "für für für"
