"""DataFrame-to-DataFrame operators; none of them triggers a job."""
