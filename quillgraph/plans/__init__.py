"""Looking at physical plans: what a query shuffles, broadcasts and runs outside the JVM."""
