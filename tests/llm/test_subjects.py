import base64
import random

import numpy as np
from pyspark.sql import functions as F

from assay.llm import mailtext, subjects

TOPIC = {"law": ["the court hearing", "a new statute", "the contract clause", "our lawyer"], "sport": ["the goalkeeper", "the relay squad", "the cup final", "the league table"]}
IDLE = ["Thanks for the quick answer.", "I will call you after lunch.", "That would be an own goal.", "Let me know if Tuesday works."]


def wording(rng, topics):
    lines = [f"We talked about {rng.choice(TOPIC[t])} again." for t in topics for _ in range(2)] + rng.sample(IDLE, 2)
    rng.shuffle(lines)
    return "Hello all,\n\n" + " ".join(lines)


def sample(n, seed):
    rng = random.Random(seed)
    return [(wording(rng, t), set(t)) for t in (rng.choice([[], ["law"], ["sport"], ["law", "sport"]]) for _ in range(n))]


def hand(pairs, names):
    marks = np.array([[s in given for s in names] for _, given in pairs], dtype=np.float32)
    return subjects.Sample(subjects.Bag.of([t for t, _ in pairs], subjects.DEFAULT), marks, np.ones(len(pairs), dtype=bool))


def test_held_out_accuracy():
    train, test = sample(300, 1), sample(200, 2)
    noisy = [(t, {"sport"} if i % 25 == 0 else s) for i, (t, s) in enumerate(train)]
    model = subjects.train(hand(noisy, ["law", "sport"]), [[]] * len(noisy), ["law", "sport"])
    bag = subjects.Bag.of([t for t, _ in test], subjects.DEFAULT)
    got = [set(c) for c in subjects.chosen(model, model.document_scores(bag), 2)]
    assert sum(g == s for g, (_, s) in zip(got, test, strict=True)) / len(test) > 0.95


def test_fits_on_executors_and_here_agree(spark):
    rows = hand(sample(80, 4), ["law", "sport"])
    every = np.ones(80, dtype=bool)
    here, there = (subjects.learn(rows, [every, ~every], [None, None], 2, subjects.DEFAULT, s) for s in (None, spark))
    assert all(np.array_equal(a, b) for a, b in zip(here, there, strict=True))


def fitted(docs, labels, areas, spec=subjects.DEFAULT):
    messages = subjects.parsed(docs, "doc_id", "text")
    return messages, subjects.fit(messages, labels, areas, spec)


def test_no_labels_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "   \n", "k"), (4, "To: x\n\nhello", "k"), (None, "hello", "k")], "doc_id long, text string, subjects string")
    labels = spark.createDataFrame([(4, None), (None, "law"), (4, "unknown"), (99, "law")], "doc_id long, subject string")
    messages, model = fitted(docs, labels, spark.createDataFrame([("law",), (None,)], "subject string"))
    got = subjects.assign(messages, model).collect()
    assert len(got) == 5 and all(r.subjects == [] for r in got)
    empty = subjects.parsed(docs.limit(0), "doc_id", "text")
    assert subjects.assign(empty, model).count() == 0 and subjects.assign(empty, model).columns == ["doc_id", "subjects"]


NOTICES = ["Nothing in this message is legal advice by the contract clause of a lawyer.", "We accept no liability if the relay squad of servers loses mail."]


def archive(spark, n, seed, labelled, notices=(), extra=""):
    rows = sample(n, seed)
    rng = random.Random(seed + 1)
    texts = [f"From: a@b.test\nSubject: Re: x\n{extra}\n{t}\n\n{rng.choice(notices) if notices and rng.random() < 0.4 else 'Bye'}\n\n> quoted about {TOPIC['law'][0]} and {TOPIC['sport'][0]}\n" for t, _ in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = [(i, f" {s.upper()} ") for i, (_, own) in enumerate(rows[:labelled]) for s in (own or {"none"})]
    return rows, docs, spark.createDataFrame(given + given[:20], "doc_id long, subject string")


def areas(spark):
    return spark.createDataFrame([("law",), ("sport",)], "subject string")


def test_end_to_end(spark):
    rows, docs, labels = archive(spark, 250, 5, 180)
    messages, model = fitted(docs, labels, areas(spark))
    got = {r.doc_id: set(r.subjects) for r in subjects.assign(messages, model).collect()}
    assert sum(got[i] == own for i, (_, own) in enumerate(rows) if i >= 180) >= 65


def test_notices_that_no_list_knows(spark):
    """Foot notices that name subjects are learned from the labels; nothing in the code knows their words."""
    rows, docs, labels = archive(spark, 420, 15, 330, NOTICES)
    messages, model = fitted(docs, labels, areas(spark))
    got = {r.doc_id: set(r.subjects) for r in subjects.assign(messages, model).collect()}
    assert sum(got[i] == own for i, (_, own) in enumerate(rows) if i >= 330) >= 84


def test_no_text_is_left_out_for_its_words():
    text = "I am confident the appeal court will overturn the ruling.\n\nThe confidence interval of the trial was wide.\n\nThe registered office moved."
    assert [len(s) for s in subjects.sentences(text)] == [10, 8, 4]


def test_any_number_of_subjects():
    model = subjects.Model(["a", "b", "c"], np.zeros((1, 3)), np.array([0.5, 0.5, 0.5]))
    scores = np.array([[0.9, 0.6, 0.7], [0.1, 0.5, 0.6]])
    assert subjects.chosen(model, scores) == [["a", "c", "b"], ["c"]]
    assert subjects.chosen(model, scores, 2) == [["a", "c"], ["c"]]


def test_address_paths():
    message = "From: Ann <ann.hill@law.test>\nTo: sport-desk@x.test,\n team-7@x.test\nList-Id: <sport-desk.x.test>\nNewsgroups: rec.garden.law\nSubject: to: nobody@z.test\n\nTo: other@z.test\n"
    got = mailtext.address_path(message, "box-1@y.test", None)
    assert got == sorted({"ann.hill@law.test", "sport-desk@x.test", "team-7@x.test", "box-1@y.test", "/ann", "/hill", "/sport", "/desk", "/team", "/box", "/rec", "/garden", "/law"})
    assert mailtext.address_path(None) == mailtext.address_path("") == []


def test_weak_labels_from_address_paths_and_subject_lines():
    names, spec = ["law", "sport"], subjects.DEFAULT
    known = sample(200, 21)
    marks = np.array([[s in given for s in names] for _, given in known], dtype=np.float32)
    paths = [["court@x.test"] if "law" in given else ["all@x.test"] for _, given in known]
    places = subjects.Places(paths, marks, names, spec)
    model = subjects.Model(names, subjects.learn(hand(known, names), [np.ones(200, dtype=bool)], [None], 3, spec)[0])
    lines = subjects.Bag.of(["Re", "the contract clause", "Re", "the contract clause", None], spec)
    scores = subjects.weak_scores(model, places, lines, [[], [], ["court@x.test"], ["court@x.test", "/new"], None])
    assert scores[1, 0] > spec.weak_above > scores[0, 0] and scores[2, 0] > scores[0, 0] and scores[3, 0] > scores[1, 0] and 0 < scores[4, 0] < spec.weak_above
    assert places.ratios([["/sport"]])[0, 1] > 1.5 > places.ratios([["/sport"]])[0, 0]  # a place with a subject's name


def test_weakly_labelled_documents_join_without_those_that_have_labels(spark, monkeypatch):
    seen = []
    learn = subjects.learn
    monkeypatch.setattr(subjects, "learn", lambda sample, *a: seen.append(sample) or learn(sample, *a))
    rows, docs, labels = archive(spark, 300, 25, 200, extra="")
    lined = docs.withColumn("text", F.expr("replace(text, 'Subject: Re: x', 'Subject: ' || CASE WHEN doc_id % 2 = 0 THEN 'the contract clause' ELSE 'Notes' END)"))
    fitted(lined.unionByName(lined.limit(30)), labels, areas(spark))
    assert seen[0].bag.documents == 200 and seen[0].hand.all()
    more = ~seen[-1].hand
    assert 30 <= more.sum() <= 50 and (seen[-1].labels[more].sum(axis=1) >= 1).all()


def own(text):
    return " ".join(mailtext.own_wording(text).split())


def test_own_wording():
    assert own(None) == own("") == own(" \n\t") == ""
    assert own("From: a@b.test\nSubject: s\n\nHello\nthere.\n\n-- \nName\nTel. 5") == "Hello there."
    assert own("no header at all") == "no header at all"
    quoted = "From: a@b.test\n\nOn 5 May 2025 10:00, A B\n<a@b.test> wrote:\n> old text\n>> older\n\nNew text."
    assert own(quoted) == "New text."
    assert own("From: a@b.test\n\nMine.\n\n-----Original Message-----\nFrom: x\nSent: y\n\nTheirs.") == "Mine."
    assert own("From: a@b.test\n\nX schrieb am 5 Feb 2025 10:00:\n: alt\n: : älter\n\nNeu.") == "Neu."
    long = "A paragraph in one line that says what went wrong, and goes on well beyond the width of a line, up to its end."
    assert own(f"Content-Type: text/html\n\n<p>{long}</p><p>A B &lt;a@b.test&gt; writes:<br>\n&gt; old</p>") == long
    assert own("From: a@b.test\n\nAu fait, un mot sur ce point\n: la suite.") == "Au fait, un mot sur ce point : la suite."


def test_forms_and_encodings():
    plain = base64.b64encode("Grüße aus Köln".encode()).decode()
    message = f'Content-Type: multipart/mixed;\n boundary="b1"\n\n--b1\nContent-Type: multipart/alternative; boundary=b2\n\n--b2\nContent-Type: text/plain; charset=us-ascii\nContent-Transfer-Encoding: base64\n\n{plain}\n\n--b2\nContent-Type: text/html\n\n<p>other</p>\n--b2--\n\n--b1\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x\n\nattached'
    assert own(message) == "Grüße aus Köln"
    assert own("Content-Type: text/html; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\n<style>p{}</style><div>caf=E9 &amp; co<br>\n&gt; old</div><p>end</p>") == "café & co end"
    assert mailtext.subject_line("Subject: =?iso-8859-1?Q?Re=3A_t=E9lescope?=\nTo: x\n\nbody") == "télescope"
    assert mailtext.subject_line("To: x\n\nSubject: body") == "" and mailtext.subject_line(None) == ""


def test_thresholds_cover_all_labels(spark, monkeypatch):
    seen = []
    calibrate = subjects.calibrate
    monkeypatch.setattr(subjects, "calibrate", lambda counts: seen.append(counts) or calibrate(counts))
    rows, docs, labels = archive(spark, 250, 8, 250)
    fitted(docs, labels, areas(spark), subjects.SubjectSpec(labelled_docs=100))
    every = sum(len(own) for _, own in rows)
    assert 0.55 * every < seen[0][0, :, 2].sum() < 0.8 * every  # all 150 outside the sample of 100, and a fifth of it
    found, right, labelled = seen[0][len(subjects.GRID) // 2].sum(axis=0)
    assert right > 0.85 * labelled and right > 0.85 * found


def test_few_labels_are_not_checked_by_their_own_model(monkeypatch):
    seen = []
    calibrate = subjects.calibrate
    monkeypatch.setattr(subjects, "calibrate", lambda counts: seen.append(counts) or calibrate(counts))
    # Every document has a word of its own that only its own model could know.
    pairs = [(f"zq{chr(97 + i)}{chr(97 + i)}. " * 4, {"law"} if i % 2 else {"sport"}) for i in range(20)]
    subjects.train(hand(pairs, ["law", "sport"]), [[]] * 20, ["law", "sport"])
    found, right, labelled = (int(x) for x in seen[0][10].sum(axis=0))
    assert labelled == 20 and right <= 0.75 * max(found, 20)
