"""Fixed values of the domain: thresholds, weights and codes that results depend on."""

# Overs of each phase; what is in none of the first two counts as death.
POWERPLAY, MIDDLE = (1, 6), (7, 15)
YEAR_FROM, YEAR_TO = 2000, 2025
MATCH_TYPE = "T20"
INNINGS_BALLS = 120
#: Wickets that are not the bowler's.
NOT_BOWLER = ("run out", "obstructing the field", "retired hurt", "retired out", "timed out", "handled the ball")
#: Wickets that count for the share called pace index.
PACE_LIKE = ("bowled", "lbw", "caught", "caught and bowled", "hit wicket")
MIN_RATED_INNINGS = 10
MIN_VENUE_INNINGS = 5
VENUE_PRIOR_WEIGHT = 20
BOOTSTRAP_DRAWS, BOOTSTRAP_BOUNDS = 500, (0.05, 0.95)
HIGH_PRESSURE_RATE = 10.0
MILESTONES = {"hundred": 100, "fifty": 50, "thirty": 30}
WICKET_HAULS = {"five_wicket_haul": 5, "four_wicket_haul": 4}
STYLES = {
    "RAF": "Right-arm fast",
    "RAFM": "Right-arm fast-medium",
    "OB": "Right-arm off-break",
    "LBG": "Right-arm leg-break googly",
    "LAF": "Left-arm fast",
    "LAFM": "Left-arm fast-medium",
    "SLA": "Slow left-arm orthodox",
    "LWS": "Left-arm wrist-spin",
}
TOURNAMENT_CODES = {"t20i_male": 0, "t20_wc_male": 0, "ipl": 1, "psl": 2, "bbl": 3, "cpl": 4, "t20_blast": 5, "sa20": 6, "lpl": 7, "ilt20": 8, "hundred_male": 9}
#: First and last position of each group of batters.
POSITION_GROUPS = {"openers": (1, 2), "top_order": (3, 5), "lower_order": (6, 8), "tail": (9, 11)}
#: Probability that a position gets to bat.
BAT_PROBABILITY = {1: 1.00, 2: 0.99, 3: 0.95, 4: 0.87, 5: 0.76, 6: 0.63, 7: 0.48, 8: 0.34, 9: 0.22, 10: 0.13, 11: 0.07}
