"""Models over match results: ratings, win probabilities, features known before a match, rosters, map pools."""
