"""Relational and ordered operators over games, rosters and ratings."""
