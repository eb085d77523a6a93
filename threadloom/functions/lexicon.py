"""Small lexicons of the extraction rules; users extend them through the operators' parameters."""

from __future__ import annotations

ORG_WORDS = frozenset("services traders logistics agency mills consultants company travels leasing limited ltd bank trust industries enterprises associates".split())
PLACE_WORDS = frozenset("nagar vihar road marg chowk mandi ghat tiraha crossing khurd kalan jadid adda post colony market station gate bazar".split())
TITLES = frozenset("mr mrs ms dr shri smt sh km insp asi constable late".split())
ROLE_WORDS = frozenset("accused complainant witness informant suspect victim".split())
ALIAS_WORDS = frozenset(["alias", "urf", "@", "उर्फ"])
NOT_NAMES = frozenset(
    "the a an and or but on in at to of for from by with he she it they his her this that was were is are as if then during later both girls vehicle notice receipt copy call room bus case number statement further nothing "
    "who did please stop according vide identity accused complainant mother father police fir plot house flat block ward monday tuesday wednesday thursday friday saturday sunday".split()
)
#: Cues of relations in the words between or around two mentions: beginnings of words, whole words where they are short; fixed values.
CALL_CUES, OWN_CUES, PRESENT_CUES, WORK_CUES = ["call", "phone", "mob", "number", "contact", "फोन", "फ़ोन", "कॉल", "मोबाइल", "नंबर"], ["own", "drive", "vehicle", "plate", "gaadi", "गाड़ी", "वाहन"], ["seen", "at", "near", "reached", "from", "देखा", "पास", "पहुंच"], ["work", "owner", "runs", "office", "employ", "काम", "मालिक"]
MONEY_CUES, FAMILY_CUES = ["paid", "transfer", "sum", "account", "froze", "rs", "inr", "रुपये", "भेजे", "खाता"], ["son", "wife", "brother", "s/o", "d/o", "associate", "together", "पुत्र", "पत्नी", "भाई", "साथ"]
