"""Multi-step jobs: studies, searches, leaderboards, forecasts, surfaces."""
