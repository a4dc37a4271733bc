"""Phrase tables of the derived review view (invented text, fixed order)."""

PROVIDERS = ("MapNotes", "TableTalk", "CityBites")

OPENERS = {
    5: (
        "Absolutely loved it.", "Best night out in months!", "What a treat.",
        "Oh great, just wonderful!", "Everything felt right.",
    ),
    4: (
        "Really nice evening.", "A solid choice.", "Good visit overall!",
        "We enjoyed our stay.", "Happy with most of it.",
    ),
    3: (
        "It was fine I guess.", "Not bad at all.", "An ordinary stop.",
        "Hard to say much.", "Of course it was not what we hoped.",
    ),
    2: (
        "Below what we hoped.", "Oh fantastic, we waited an hour!", "Rather disappointing.",
        "Hardly a good choice.", "We were disappointed again.",
    ),
    1: (
        "Terrible from start to end.", "Worst visit of the year!", "Just great, cold again.",
        "Awful in every way.", "We regret this mistake.",
    ),
}

FIRST_CLAUSES = (
    "the food was delicious and fresh",
    "the pasta wasn't good at all",
    "the waiter was friendly and fast",
    "the service was painfully slow",
    "the atmosphere felt cozy and nice",
    "the music was never bad",
    "the price seemed reasonable and fine",
    "everything was overpriced for the value",
    "the tables were spotless and clean",
    "the bathroom floor was filthy and dirty",
    "we sat and talked for a while",
    "the soup arrived cold",
    "the host was not helpful and the line was long",
)
CONNECTORS = (
    " but ", " however ", " although ", " though ", " yet ", " despite ",
    " and ", ". Still, ", " But ", " BUT ",
)
SECOND_CLAUSES = (
    "the staff was rude and unacceptable",
    "the dessert tasted excellent",
    "dinner was bland, burnt and stale",
    "the team made us feel welcome, amazing people",
    "the room was crowded and noisy",
    "the decor was beautiful",
    "it was worth the money",
    "the bill was not cheap",
    "the mess on the floor was disgusting",
    "they said the seating had improved",
    "nothing else stood out",
)
TAILS = (
    "", "", "", "",
    " See you next week.",
    " Thank you to everyone!",
    " Yeah right, best ever.",
    " Obviously the soup was cold!",
    " Clearly they do not listen.",
    " My friend got food poisoning.",
    " The step was slippery and someone fell.",
    " They refused service to my family.",
    " We were charged twice on one credit card.",
    " Total waste, avoid at all costs!",
    " I am grateful, even the bug was gone.",
    " LOUD PLACE!!",
    " We will come again.",
    " I'd recommend it to friends.",
)
