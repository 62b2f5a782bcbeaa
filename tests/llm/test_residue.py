import random

import pytest

from dossier.llm import residue

GOOD = ["The contractor shall deploy {} workers for pest control.", "Damage caused shall be repaired within {} days of notice.", "Each lot of floor tiles will bear batch label {}.", "Offers must reach the box before noon on {} May.", "Bidders must allow JavaScript in the browser and insert the signing token before uploading page {}.", "Signature of witness ______________ and date ________ below seal {}.", "Set {{a, b, c}} of item {} shall be quoted together, and item (iii) [optional] apart.", "The crew found that door {} gave an access denied tone to two guards.", "Placeholder bolts of size {} are to be replaced."]
BAD = ["Dear {{bidder_name}}, your offer has been registered.", "For and on behalf of [YOUR COMPANY], signatory.", "Loading document viewer... please wait", "404 Not Found", "Access denied. You do not have permission to view /bids/3.", "Lorem ipsum dolor sit amet velit nunc", "This is to certify that <<NAME OF FIRM>> has executed the job.", "xxxx xxxxx xxxx xxxx", "Amount payable: #REF! only", "Your session has expired. Log in once more.", "कृपया इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें।"]


SEEDED = ["Dear {{bidder_name}}, your offer has been registered.", "404 Not Found", "Lorem ipsum dolor sit amet velit nunc", "xxxx xxxxx xxxx xxxx", "Your session has expired. Log in once more.", "कृपया इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें।", "The scope: [insert scope of work]"]


@pytest.mark.parametrize("text", SEEDED)
def test_trusted(text):
    assert residue.trusted(text)


@pytest.mark.parametrize("text", GOOD)
def test_not_trusted(text):
    assert not residue.trusted(text.format(7))


def test_records(spark):
    rng = random.Random(4)
    rows, bad = [], set()
    seeded = [x for x in BAD if residue.trusted(x)]
    for k in range(700):
        lines = [rng.choice(GOOD).format(rng.randrange(99)) for _ in range(rng.randrange(2, 7))]
        if k % 9 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(seeded))
            bad.add(k)
        rows.append((k, "\n".join(lines), "kept"))
    filler = "velit ipsum nunc dolor amet sit erat quam odio vitae felis arcu justo porta".split()
    for k in range(700, 780):  # half are never trusted: they are found by the words they share with trusted passages
        rows.append((k, ("Lorem ipsum " if k % 2 else "") + " ".join(rng.choice(filler) for _ in range(20)), "kept"))
        bad.add(k)
    rows += [(900, None, "kept"), (901, "", "kept"), (902, GOOD[0].format(3) * 3000, "kept")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, p string")
    assert {r.doc_id for r in residue.residue_ids(documents).collect()} == bad
    kept = residue.without_residue(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - bad
    assert residue.residue_ids(documents.limit(0)).count() == 0
    assert residue.residue_ids(documents.where("doc_id in (1, 2, 900)")).count() == 0


SLOTS = ["{{firm}}", "[Insert name]", "<<NAME OF FIRM>>", "«firm_address»", "${contract_value}", "@@work_order@@", "%TENDER_NO%", "#REF!", "__BIDDER_NAME__", "<bidder name>", "&lt;%= buyer %&gt;", "XX/XX/20XX"]
FRAMES = ["Dear {}, your offer has been registered with us.", "This is to certify that {} has executed the above job to our satisfaction.", "Amount payable against this order: {} inclusive of all taxes.", "For and on behalf of {}, authorised signatory.", "Last day of receipt of offers is {} as per the notice."]
MESSAGES = ["404 Not Found", "The requested document could not be located on this server.", "Access denied.", "You do not have permission to view this page.", "Your session has expired.", "Sign in again to continue.", "Oops!", "Something went wrong while loading this page.", "This page needs scripts.", "Please turn on JavaScript."]
HIDDEN = [*SLOTS[2:], MESSAGES[1], MESSAGES[2], MESSAGES[3], MESSAGES[5], MESSAGES[8]]


def test_hidden_families(spark):
    """No seed has a mark of the families in HIDDEN: the model finds at least nine in ten of their records, and no content."""
    rng = random.Random(8)
    rows, hidden = [], {}
    for k in range(2500):
        lines = [rng.choice(GOOD).format(rng.randrange(99)) for _ in range(rng.randrange(2, 7))]
        if k % 7 == 0:
            lines.insert(1, rng.choice(FRAMES).format(slot := rng.choice(SLOTS)))
            hidden[k] = slot in HIDDEN
        elif k % 11 == 0:
            lines = rng.sample(MESSAGES, 3)
            hidden[k] = not any(residue.trusted(x) for x in lines)
        rows.append((k, "\n".join(lines)))
    assert not any(residue.trusted(x) for x in HIDDEN)
    found = {r.doc_id: r.trusted for r in residue.residue_ids(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    unseeded = {k for k, h in hidden.items() if h}
    assert len(unseeded) > 200
    assert set(found) <= set(hidden)
    assert len(unseeded & set(found)) >= 0.9 * len(unseeded)
    assert not any(found[k] for k in unseeded & set(found))
