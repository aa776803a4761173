"""The registered queries: each takes (spark, folder) and has the same name as its SQL, where SQL can express it."""
