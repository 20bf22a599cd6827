"""neumata: score and corpus analytics on Spark."""
