"""Canonical schemas."""

from __future__ import annotations

#: Games as they stand in files: eight text columns.
RAW_GAMES = "time string, team1 string, score1 string, team2 string, score2 string, outcome_flag string, tourney_flag string, players_field string"
GAMES = "game_id long, ts timestamp, time_raw string, team1 string, score1_raw string, team2 string, score2_raw string, s1 int, s2 int, outcome_only boolean, tournament boolean, players_on_court int, outcome_raw string, tournament_raw string"
ROSTERS = "team string, slot long, player string"
RATINGS = "player string, mu double, sigma double"
HISTORY = "model string, ts timestamp, player string, rating double"
