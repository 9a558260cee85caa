"""Fixed values of the formats and rules."""

#: Camera generations, in code order 0..5; code 6 is unknown.
GENERATIONS = ("badcam", "gen1", "gen2", "gen3", "gen4", "trekker")
#: Other names of countries.
COUNTRY_ALIASES = {"United States": "USA", "United States of America": "USA"}
#: Radius and distances in metres, limits of a result and of an exclude list.
EARTH_RADIUS_M = 6_371_000.0
PRUNE_M, USED_M, DUPLICATE_M = 100.0, 25.0, 25.0
MAX_RESULTS, MAX_EXCLUDED = 10_000, 10_000
#: Prefixes of invented panorama ids.
INVENTED = ("synthetic:", "Prototype", "CommunityPano", "wikimedia:")
#: Side of a face in pixels, faces of a panorama.
FACE, FACES = 16, 6
#: View direction -> allowed quarter turns from the original heading.
DIRECTIONS = {
    "bestOfFour": (0, 1, 2, 3), "original": (0,), "right": (1,), "opposite": (2,), "left": (3,), "originalAxis": (0, 2), "sideAxis": (1, 3),
}
#: Scene mode: smallest similarity by description weight.
SCENE_FLOORS = {0: 0.8842786, 25: 0.83858335, 50: 0.6531793, 75: 0.36236486, 100: 0.01}
#: Object mode: smallest similarity by confidence.
CONFIDENCE_FLOORS = {"highRecall": 0.03, "balanced": 0.08, "precise": 0.20}
#: Description weights, costs, lease seconds.
WEIGHTS = (0, 25, 50, 75, 100)
SEARCH_COST, UNITS = 100_000, {"scene": 1, "object": 10}
STEAL_S, BROWSER_LEASE_S, CLI_LEASE_S = 21_600, 1_800, 21_600
#: Families of shard keys by prefix, in order; others come last.
FAMILIES = (("catalog/all-locations-tail-v1/", "new-places"), ("catalog/all-locations-full-v1/", "whole-map"), ("catalog/vision-indexed-v1/", "already-indexed"))
#: Range of global ids.
GLOBAL_BASE, GLOBAL_STRIDE = 2**32, 2**16

#: Class ids and names; ids have gaps.
CLASSES = (
    (1, "person"), (2, "bicycle"), (3, "car"), (4, "motorcycle"), (5, "airplane"), (6, "bus"), (7, "train"), (8, "truck"), (9, "boat"),
    (10, "traffic light"), (11, "fire hydrant"), (13, "stop sign"), (14, "parking meter"), (15, "bench"), (16, "bird"), (17, "cat"),
    (18, "dog"), (19, "horse"), (20, "sheep"), (21, "cow"), (22, "elephant"), (23, "bear"), (24, "zebra"), (25, "giraffe"),
    (27, "backpack"), (28, "umbrella"), (31, "handbag"), (32, "tie"), (33, "suitcase"), (34, "frisbee"), (35, "skis"), (36, "snowboard"),
    (37, "sports ball"), (38, "kite"), (39, "baseball bat"), (40, "baseball glove"), (41, "skateboard"), (42, "surfboard"),
    (43, "tennis racket"), (44, "bottle"), (46, "wine glass"), (47, "cup"), (48, "fork"), (49, "knife"), (50, "spoon"), (51, "bowl"),
    (52, "banana"), (53, "apple"), (54, "sandwich"), (55, "orange"), (56, "broccoli"), (57, "carrot"), (58, "hot dog"), (59, "pizza"),
    (60, "donut"), (61, "cake"), (62, "chair"), (63, "couch"), (64, "potted plant"), (65, "bed"), (67, "dining table"), (70, "toilet"),
    (72, "tv"), (73, "laptop"), (74, "mouse"), (75, "remote"), (76, "keyboard"), (77, "cell phone"), (78, "microwave"), (79, "oven"),
    (80, "toaster"), (81, "sink"), (82, "refrigerator"), (84, "book"), (85, "clock"), (86, "vase"), (87, "scissors"), (88, "teddy bear"),
    (89, "hair drier"), (90, "toothbrush"),
)
#: Other names of classes.
CLASS_ALIASES = {
    1: ("people", "human", "humans"), 2: ("bike", "bikes", "cycle", "cycles"), 3: ("automobile", "automobiles", "vehicle", "vehicles"),
    4: ("motorbike", "motorbikes"), 5: ("plane", "planes", "aircraft", "aeroplane", "aeroplanes", "jet", "jets"), 16: ("birds",),
    17: ("cats", "kitten", "kittens"), 18: ("dogs", "puppy", "puppies"), 37: ("ball", "balls"), 63: ("sofa", "sofas"),
    64: ("plant", "plants", "houseplant", "houseplants"), 72: ("television", "televisions"),
    77: ("phone", "phones", "smartphone", "smartphones", "mobile phone"), 82: ("fridge", "fridges"), 89: ("hair dryer", "hair dryers"),
}
#: Phrases with a route of their own, words that a route ignores.
HOT_PHRASES = (("bird nest", "bird nests", "nest", "nests"), ("clock", "clocks"))
GLUE = ("a", "an", "and", "anywhere", "find", "me", "object", "objects", "or", "pano", "panorama", "show", "the", "things")
#: Irregular plurals, then endings (the part that stays in a group) with what follows it.
PLURALS = {"person": "people", "mouse": "mice", "sheep": "sheep", "knife": "knives"}
PLURAL_ENDINGS = (("(ch|sh|s|x|z)$", "es"), ("([^aeiou])y$", "ies"), ("(.)$", "s"))
PROMPT_MAX = 400
#: Storage floors of classes by id and by range of ids, else 0.05.
FLOOR_01 = (5, 16, 17)
FLOOR_03, FLOOR_03_RANGES = (2, 10, 11, 13, 14, 18, 27, 28, 64), ((31, 61), (73, 77), (84, 90))
#: Palette phrases and their colours, longest phrase first.
PALETTE = (
    ("bird nest", 96, 72, 48), ("forest", 28, 88, 38), ("ocean", 20, 70, 140), ("water", 32, 92, 154), ("night", 22, 26, 42),
    ("brick", 150, 62, 48), ("snow", 240, 244, 248), ("sand", 196, 168, 118), ("road", 86, 86, 86), ("sky", 92, 152, 214),
    ("orange", 220, 120, 30), ("purple", 130, 50, 170), ("yellow", 210, 190, 40), ("green", 40, 160, 50), ("brown", 120, 70, 40),
    ("white", 230, 230, 230), ("black", 25, 25, 25), ("pink", 210, 90, 140), ("blue", 40, 70, 190), ("grey", 128, 128, 128),
    ("gray", 128, 128, 128), ("red", 210, 42, 42),
)
#: Words that darken and lighten a tint.
DARK_WORDS = ("dark", "night", "black", "shadow")
BRIGHT_WORDS = ("bright", "sunny", "white", "snow", "daylight")
