"""Small tables of cases with the results that the rules give, worked out by hand."""

KIND_INPUTS = [
    ("a.PDF", 10, "%PDF", True),
    ("b.docx", 10, "PK\x03\x04", True),
    ("c.xlsx", 10, "abcd", True),
    ("d.TSV", 5, "a", True),
    ("e.tiff", 5, "II", True),
    (".env", 5, "A", True),
    (".env.example", 5, "A", True),
    ("f.bin", 5, "A", True),
    ("dir.txt", 0, None, False),
    ("g.txt", 300 * 1024 * 1024, "x", True),
    ("h.txt", 5, None, True),
    ("i.txt", -1, None, True),
    ("j.txt", 0, "", True),
    ("noext", 3, "x", True),
]
KIND_RESULTS = [
    ("a.PDF", "pdf", None),
    ("b.docx", "docx", None),
    ("c.xlsx", "xlsx", "not a zip container (likely encrypted Office file)"),
    ("d.TSV", "csv", None),
    ("e.tiff", "image", None),
    (".env", None, "unknown type"),
    (".env.example", None, "unknown type"),
    ("f.bin", None, "unknown type"),
    ("dir.txt", "text", "not a regular file"),
    ("g.txt", "text", "too large"),
    ("h.txt", "text", "permission denied"),
    ("i.txt", "text", "cannot stat"),
    ("j.txt", "text", None),
    ("noext", None, "unknown type"),
]

FAMILY_RESULTS = [
    ("specs/pump_r1.txt", "specs/pump", 1, False),
    ("specs/pump_r2.txt", "specs/pump", 2, True),
    ("specs/pump_r3_WITHDRAWN.txt", "specs/pump", 3, False),
    ("specs/pump.txt", "specs/pump", -1, True),
    ("docs/pump_r1.txt", "docs/pump", 1, True),
    ("specs/valve-rev-2b.pdf", "specs/valve", 2, False),
    ("specs/valve_rev3.docx", "specs/valve", 3, True),
    ("notes_v4.3.2.txt", "/notes_3_2", 4, True),
    ("final draft.txt", "/", -1, True),
    ("old.txt", "/", -1, True),
]
FAMILY_INPUTS = [rel for rel, *_ in FAMILY_RESULTS]

SAYINGS = [
    (1, "This revision is now withdrawn."),
    (2, "Revision 1 was withdrawn; this is revision 2"),
    (3, "status: obsolete"),
    (4, "Do not use for new  designs"),
    (5, "superseded by r4"),
    (6, "What did the earlier revision say?"),
    (7, "value in r1 please"),
    (8, "value in r12 please"),
    (9, "rev 1 of it"),
    (10, "this specification has been retired"),
    (11, ""),
]

ANSWERS = [
    ("94 °C", "94"),
    ("$1,200", "1,200"),
    ("12V", "12"),
    ("REV-C2 (main)", "REV-C2"),
    ("Not found", ""),
    ("94.", "94."),
    ('"Q3 FY27"', "Q3 FY27"),
    ("Answer: 40A", "40"),
    ("value： TQ-40;", "TQ-40"),
    ("one two three four five six seven eight nine", ""),
    ("E7731.", "E7731."),
    ("-3.5 kg", "-3.5"),
    ("n/a", ""),
    ("  ", ""),
    ("12 rpm", "12 rpm"),
    ("95%", "95"),
    ("x" * 81, ""),
]

# (id, reply, steps, answer, sources)
REPLIES = [
    (1, '{"steps": "s", "answer": "94", "sources": ["a.txt", "b.csv"]}', "s", "94", ["a.txt", "b.csv"]),
    (2, '```json\n{"answer": 12, "sources": ["a.txt", 5]}\n```', "", "12", ["a.txt"]),
    (3, 'Sure: "answer": "x\\"y" from "d/e.pdf"', "", 'x\\"y', ["d/e.pdf"]),
    (4, '{"answer": true, "sources": "a.txt"}', "", "True", []),
    (5, "no idea", "", "", []),
    (6, '{"answer": null}', "", "", []),
    (7, 'text {"answer": "a", } more', "", "a", []),
    (8, "", "", "", []),
    (9, 'so: {"answer": "b", "sources": []} done', "", "b", []),
]

VALUE_MATCHES = [
    ("4.3.2", "v4.3.2", True),
    ("4.3.2", "4 3 2", True),
    ("4.3.2", "14.3.2", False),
    ("4.3.2", "4.3.20", False),
    ("Q3 FY27", "in Q3FY27.", True),
    ("Q3FY27", "q3 fy27", True),
    ("TQ-40", "the tq 40 fan", True),
    ("TQ-40", "TQ-401", False),
    ("$5", "cost $5 now", True),
    ("a+b", "x a+b", True),
    ("...", "...", False),
    ("", "x", False),
]
VALUES = ["the", "und", "avec", "que", "is", "BY-NC"]

RECOGNISED = [
    ("TYPE: US_PLATE\nTEXT: Texas 7abc123", "US_PLATE", "7ABC123"),
    ("TYPE: US_PLATE\nTEXT: Texas", "US_PLATE", "TEXAS"),
    ("TYPE: CN_PLATE\nTEXT: 京A・12345", "CN_PLATE", "京A·12345"),
    ("STOP", "SIGN", "STOP"),
    ("**TYPE**: OTHER_PLATE\n**TEXT**: www.site.com AB 12 CD", "OTHER_PLATE", "AB 12 CD"),
    ("TYPE: SIGN\nTEXT: first\nTEXT: “Main  St”", "SIGN", "MAIN ST"),
    ("TYPE: BUS SIGN\nTEXT: Ｅ１２", "US_PLATE", "E12"),
    ("TYPE: US_PLATE\nTEXT: 10,000 Lakes ABC 123 State of", "US_PLATE", "ABC 123"),
    ("line one\nline two", "SIGN", "LINE ONE LINE TWO"),
    ("TEXT: plate: abc", "SIGN", "ABC"),
    ("type： us\ntext： America's Dairyland 55-X", "US_PLATE", "55-X"),
    ("", "SIGN", ""),
]

# (id, probabilities, width, height, confidence, width and height for the model)
IMAGES = [
    (1, [0.5, 0.25], 800, 600, 0.3536, 800, 600),
    (2, [], 3200, 1600, 0.0, 1600, 800),
    (3, [1.0], 320, 100, 1.0, 640, 200),
    (4, [0.0, 1.0], 1, 1, 0.0, 640, 640),
]

EXPECTED = [("a.png", "7ABC123"), ("b.png", "京A·12345"), ("c.png", "STOP"), ("d.png", "X")]
ACTUAL = [("a.png", "7abc-123", 1.5, True), ("b.png", "京A12345", 0.5, True), ("c.png", None, 2.5, True)]
SCORE = (40, 80, 2.5)

QUESTION_FILES = [
    ("q/one.txt", "What is it?\n"),
    ("q/obj.json", '{"id": 7, "query": "a"}'),
    ("q/list.json", '["x", {"qid": "k", "text": "y"}, 3, {"prompt": "z"}, {"question": 4}]'),
    ("q/s.json", '"solo"'),
    ("q/num.json", "12"),
]
QUESTION_RESULTS = [
    ("q/one.txt", 1, "one", "What is it?"),
    ("q/obj.json", 1, "7", "a"),
    ("q/list.json", 1, "list_1", "x"),
    ("q/list.json", 2, "k", "y"),
    ("q/list.json", 4, "list_4", "z"),
    ("q/list.json", 5, "list_5", ""),
    ("q/s.json", 1, "s", "solo"),
]

TO_WRITE = [("a b/c", "v", ["f"], 0.9), ("..", None, ["f"], 0.0)]
WRITTEN = [
    ("a_b_c_output.json", '{"answer":"v","citations":["f"],"confidence":0.9}'),
    ("query_output.json", '{"answer":"","citations":[],"confidence":0.0}'),
]

# A small corpus: (path, units of text, place, whether it is a table row), in the order of the walk.
CORPUS = [
    ("logs/fan.log", [("fan stalled, see ticket ORR-1847 and call service", "file", False)]),
    ("specs/pump_r1.txt", [("Pump flow is 80 liters.", "file", False)]),
    ("specs/pump_r2.txt", [("Pump flow is 94 liters.", "file", False)]),
    ("specs/pump_r3_WITHDRAWN.txt", [("Pump flow is 99 liters.", "file", False)]),
    ("specs/valve.txt", [("This revision is withdrawn. Valve torque is 12.", "file", False)]),
    (
        "tickets/index.csv",
        [
            ("csv columns: ticket | fixed in", "csv header", True),
            ("csv | ticket: ORR-1847 | fixed in: 4.3.2", "csv row 2", True),
            ("csv | ticket: ORR-2000 | fixed in: 4.4.0", "csv row 3", True),
        ],
    ),
]
CORPUS_FLAGS = [
    ("logs/fan.log", False),
    ("specs/pump_r1.txt", True),
    ("specs/pump_r2.txt", False),
    ("specs/pump_r3_WITHDRAWN.txt", True),
    ("specs/valve.txt", True),
    ("tickets/index.csv", False),
]
# (id, question, recorded reply, answer, citations, confidence)
QUESTIONS = [
    ("q1", "Which firmware version fixed the stalled fan?", '{"answer": "4.3.2", "sources": ["logs/fan.log", "tickets/index.csv"]}', "4.3.2", ["tickets/index.csv", "logs/fan.log"], 0.9),
    ("q2", "What is the pump flow?", '{"answer": "94 liters", "sources": ["specs/pump_r2.txt"]}', "94 liters", ["specs/pump_r2.txt"], 0.9),
    ("q3", "What is the torque of the valve?", '{"answer": "12", "sources": ["specs/valve.txt"]}', "", [], 0.0),
    ("q4", "What was the original pump flow in revision 1?", '{"answer": "80", "sources": ["pump_r1.txt"]}', "80", ["specs/pump_r1.txt"], 0.9),
    ("q5", "   ", "{}", "", [], 0.0),
]
SHOWN = ["logs/fan.log", "tickets/index.csv", "specs/pump_r2.txt"]
# (id, question, answer, named files, shown files, citations)
CITED = [
    ("q1", QUESTIONS[0][1], "4.3.2", ["logs/fan.log", "tickets/index.csv"], SHOWN, ["tickets/index.csv", "logs/fan.log"]),
    ("q2", QUESTIONS[1][1], "94 liters", ["specs/pump_r2.txt"], SHOWN, ["specs/pump_r2.txt"]),
    ("q4", QUESTIONS[3][1], "80", ["specs/pump_r1.txt"], [*SHOWN, "specs/pump_r1.txt"], ["specs/pump_r1.txt"]),
]
UNCITED = [("q3", QUESTIONS[2][1], "12", [], SHOWN)]
FILE_IDS = [("logs/fan.log", "ORR1847"), ("tickets/index.csv", "ORR1847"), ("tickets/index.csv", "432"), ("tickets/index.csv", "ORR2000"), ("tickets/index.csv", "440")]
BRIDGES = [("q1", 0, "ORR1847"), ("q1", 1, "432"), ("q1", 2, "ORR2000"), ("q1", 3, "440")]
RANKING = [
    ("q1", 0, "logs/fan.log", "file"),
    ("q1", 1, "tickets/index.csv", "csv header"),
    ("q1", 2, "tickets/index.csv", "csv row 2"),
    ("q1", 3, "tickets/index.csv", "csv row 3"),
    ("q2", 0, "specs/pump_r2.txt", "file"),
    ("q4", 0, "specs/pump_r1.txt", "file"),
    ("q4", 1, "specs/pump_r2.txt", "file"),
    ("q4", 2, "specs/pump_r3_WITHDRAWN.txt", "file"),
    ("q4", 3, "specs/valve.txt", "file"),
]

ALLOWED = ["a/x.txt", "b/x.txt", "c/y.csv"]
NAMES = [
    (1, ["x.txt"], ["a/x.txt"]),
    (2, ["b/x.txt", "./c/y.csv"], ["b/x.txt", "c/y.csv"]),
    (3, ["/mnt/app/corpus/b/x.txt"], ["b/x.txt"]),
    (4, ["z.txt"], []),
    (5, ["q/y.csv", "y.csv"], ["c/y.csv"]),
    (6, ["/app/corpus/b/x.txt"], ["a/x.txt"]),
]
