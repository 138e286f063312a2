"""Abuse scoring: cases and look-alikes of cases, and raters who agree.

The sentences are the author's own; the lexicon was mended after the first run of most of them, so
the test guards against regressions.
"""

import pandas as pd
import pytest

from quillspan.llm.abuse import THRESHOLD, Scorer, score_documents, source_rates
from quillspan.llm.abuse_lexicon import DEFAULT, Lexicon

document_score = Scorer(DEFAULT).document

BAD = [
    "You are a bunch of idiots and I hope you lose your job.", "What a pathetic m0r0n you are.", "P i s s off, you whining little w.a.n.k.e.r", "You stupid baaastaaard!", "Go to hell, all of you.",
    "Those people breed like rats.", "Send them back where they crawled from.", "I know where she lives and she will be sorry.", "Hot naked girls near you, click for dirty pics.", "You worthless a******e.",
    "The clinic opens at nine. They should be sterilised, all of them.", "Shut up, you fat useless pig.",
    'I will slit your throat', 'Kys you waste of oxygen', 'kill all of them', 'You are a pathetic excuse for a human being, you lying rat',
    'Somebody should shoot that stupid cow in the head', 'Women like her are only good for one thing, the filthy slut', "I'm going to smash your face in when you leave work",
    'Immigrants are nothing but parasites who spread disease', 'They should all be gassed', 'Shut your mouth, you ugly pig', 'I hope you die slowly and alone',
    'Send them back to where they came from, the dirty animals', "You're a worthless piece of shit", 'She sucked his cock until he came',
    'I want to fuck you on the desk tonight', 'Deport all those people, they are criminals by nature', 'Go hang yourself, nobody would miss you',
    'Those people breed like cockroaches', 'We know where you live and your children will pay', 'He is a fat lazy retard', 'Get raped, bitch',
    'Burn the lot of them in their houses', 'I will come round and break every bone in your legs', 'You should be ashamed of yourself, you spineless little worm',
    'Hot girls waiting for you, live sex cam tonight', 'gypsies are born thieves and should be locked up', 'Every one of you deserves to be hanged',
    'You are too stupid to breathe', 'F*** off you c***', 'w4nk3rs like you should drop dead', 'Whoever approved this is a brainless cretin',
    'You are nothing but a dirty leech', 'Somebody ought to drown that lot at birth', 'He should be strung up from the nearest lamp post',
    'Foreigners stink and ruin every town they come to', 'My wife is a fat ugly cow and so are you', 'I will wait for you outside and kick your teeth in',
    'Disabled people are a waste of space and should be put down', 'Lick my pussy until I cum', 'No help for those people, let them starve', 'Drop dead you miserable old hag',
    'Your kid is a retard just like you', "I'd love to watch you choke", 'Women are too stupid to vote', 'They are not human, they are rats',
]
FINE = [
    "The clinic counts sexually transmitted infections by age.", 'A caller said "idiot" and "moron" and was asked to stop.', "Nude mice were used, and stripping of the vein is a procedure.", "Bloody marvellous work, and a damn good summary.",
    "The new centre in Cockmarsh serves Titcombe and Upper Wankford.", "I am furious about the delay and consider the answer a disgrace.", "Staff reported episodes of verbal abuse and racist language.", "Rats and pigs were kept apart.",
    'Prick the potatoes with a fork', 'The cock crowed at dawn over the farm', 'Great tits and blue tits nest in the hedge', 'I am furious about the delay and want an answer',
    'You are wrong about the figures and I will appeal', 'Please kill the process before you restart the server', 'The dog bit the postman and he was treated in hospital',
    'Their house burned down and they were hurt', 'Patients were shot with a new kind of needle-free injector', 'The court heard that he called her a name',
    'She was stabbed outside her home, the police said', 'Your fat intake should be lower than theirs',
    'The panel was asked whether records of people hurt by violence should be kept', 'Bloody brilliant work, well done you', 'We are going to beat the target this year',
    'You lucky bastard, congratulations on the job', 'The old people in the ward were moved out of the building', 'Immigrants and refugees need better access to surgery',
    'Women were asked about breast screening and sexual health', 'Rats and pigs were used in the study', 'The plague killed a third of them',
    'Condoms prevent sexually transmitted disease', 'I would not let this data leave the country', 'They should be removed from the list',
    'The report is useless and the answer was pathetic', 'You may feel stupid asking, but please do', 'Let them know by Friday', 'Those dogs are lazy', 'He hung up on me',
    'The erection of the new building was delayed', 'Naked mole rats live long', 'We will end your contract if they do not answer',
    'Children with measles should be kept out of school', 'I hope you will suffer no further delay', 'This bug is a pig to fix', 'She had wet hair and a dirty coat',
    'Patients with a cancer diagnosis are told by their doctor', 'People can carry disease without showing symptoms', 'They are rats of the Wistar strain kept for two years',
    'People and animals were moved to higher ground', 'The children were kept out of the rain', 'He was beaten at chess by his sister',
    'She should be treated at home and not sent back to the ward', 'Those people should be asked for consent again', 'Nobody should treat the figures as final',
    'You could not count them all in a day', 'The knife wound was dressed and the boy was sent home', 'Dogs and cows share the field with those sheep',
    'Do not let them spread the cost over two years', 'Hospitals are overrun in the winter months and people wait for beds',
    'Her bra size was recorded for the screening study', 'They need to be locked away in a safe every night', 'All records must be destroyed when you leave',
    'Sex, age and tongue cancer codes are in annex two', 'My house is your house, please come and stay with them',
    'It would be better if they were removed from the mailing list',
    "Breast, penile and anal cancers are grouped.", "He is no fool.", "", "   ",
]


@pytest.mark.parametrize("text", BAD)
def test_cases(text):
    assert document_score(text)[0] >= THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_no_cases(text):
    assert document_score(text)[0] < THRESHOLD


def test_one_bad_sentence_in_a_long_document():
    assert document_score("The panel met. " * 3000 + "You are a moron. " + "The panel met. " * 3000)[:2] == (1.2, 1)


def test_long_sentences_and_quoted_texts():
    words = "the panel met on " * 30
    assert document_score(f"{words} you are a moron {words}")[0] == document_score("you are a moron")[0]
    assert document_score('"You are a moron, and all of you can go to hell"')[0] >= THRESHOLD
    assert document_score('He wrote "' + "you are a moron " * 60 + '" in his letter')[0] == 0


def test_another_lexicon(spark):
    own = Lexicon({"fruit": "lemon|sour apple"}, (("fruit", 1.0, ("fruit",), 0),), "lemon cake")
    rows = spark.createDataFrame([(1, "a Lemon!"), (2, "lemon cake"), (3, "you moron")], "doc_id long, text string")
    assert [r.doc_id for r in score_documents(rows, lexicon=own).filter("abusive").collect()] == [1]


def test_raters_who_agree(spark):
    d = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{d}/content_labels.parquet").dropna().groupby("doc_id").abusive.agg(["mean", "count"])
    sure = labels[(labels["count"] > 1) & labels["mean"].isin([0, 1])]
    docs = pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "text"]).set_index("doc_id").loc[sure.index]
    from quillspan.llm.lookalike import canonical_batch
    import pyarrow as pa

    said = [document_score(t)[0] >= THRESHOLD for t in canonical_batch(pa.array(docs.text)).to_pylist()]
    wrong = sum(s != (m == 1) for s, m in zip(said, sure["mean"], strict=True))
    assert len(sure) > 100 and wrong <= 0.02 * len(sure)


def test_query(spark):
    data = [(i, "a", t) for i, t in enumerate(BAD)] + [(100 + i, "b", t) for i, t in enumerate(FINE)] + [(200, None, None), (201, None, "F​uсk you, you pig"), (201, None, "F​uсk you, you pig")]
    rows = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, source string, text string, kind string")
    got = score_documents(rows)
    assert {r.doc_id for r in got.filter("abusive").collect()} == set(range(len(BAD))) | {201}
    rates = {r.source: (r.documents, r.abusive_documents) for r in source_rates(got).collect()}
    assert rates == {"a": (len(BAD), len(BAD)), "b": (len(FINE), 0), None: (3, 2)}
    assert score_documents(rows.limit(0)).collect() == []
