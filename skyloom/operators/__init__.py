"""DataFrame operators: tables, matching, sky maps, calibration, decisions, light curves, schedules."""
